"""Pairs of near-equal values within blocks, found without scoring every pair.

Every pair of a block at or above the threshold is found. Pairs are left out only where a bound on their score, which
holds for any text, stays below it: letters that one text has and the other has not cost each scorer a known share, and
the token-set score is reached either through few changed letters or through shared tokens, which an index finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions import scorers
from loamgrid.operators.components import components
from loamgrid.session import cut

# Nodes of a block that one task compares with as many others; pairs that are bounded and scored at once.
TILE, AT_ONCE = 32_768, 1 << 19
# Fixed value: the share of each scorer that depends on the letters in common; the token set score has bounds of its own.
BY_LETTERS = {"hybrid": 45.0, "ratio": 100.0, "token_set": 0.0}
_EPS = 1e-6


def _tiled(nodes: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(placed, large): the nodes beside all that they are compared with, and the blocks in more than one tile.

    Blocks of more than TILE nodes are cut into tiles; each pair of tiles is compared on its own. Reads `nodes` twice.
    """
    large = nodes.groupBy("_block").agg(F.count("*").alias("_size")).where(F.col("_size") > TILE)  # one row for TILE nodes at most
    k = F.coalesce(F.ceil(F.col("_size") / TILE), F.lit(1)).cast("int")
    tiled = nodes.join(F.broadcast(large), "_block", "left").withColumn("_k", k).withColumn("_t", F.pmod(F.xxhash64("_node"), "_k").cast("int"))
    met = tiled.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).select("_block", F.least("_t", "_o").alias("_i"), F.greatest("_t", "_o").alias("_j"), "_t", "_node", *columns)
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(tasks, "_block", "_i", "_j").sortWithinPartitions("_block", "_i", "_j"), large


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in frames of whole groups (_block, _i, _j)."""
    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + len(b)
        if n < 20_000 or held[0].iloc[0][["_block", "_i", "_j"]].equals(b.iloc[-1][["_block", "_i", "_j"]]):
            continue
        frame = pd.concat(held, ignore_index=True)
        last = frame.iloc[-1]
        end = int(((frame["_block"] != last["_block"]) | (frame["_i"] != last["_i"]) | (frame["_j"] != last["_j"])).sum())
        yield frame.iloc[:end]
        held, n = [frame.iloc[end:]], len(frame) - end
    if n:
        yield pd.concat(held, ignore_index=True)


def pairs(nodes: DataFrame, columns: list[str], threshold: float, weights: list[float], scorer: str, rounded: bool = False) -> DataFrame:
    """(src, dst, score) of nodes (_block, _node, columns) of one block that score `threshold` and more."""
    kind, used = dict(nodes.dtypes)["_node"], _used(columns, weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole(batches):
            yield from compare(frame, used, threshold, scorer, rounded)

    return _tiled(nodes, columns)[0].mapInPandas(run, f"src {kind}, dst {kind}, score double")


def groups(nodes: DataFrame, columns: list[str], threshold: float, weights: list[float], scorer: str, rounded: bool = False) -> DataFrame:
    """(_block, columns, _group, _score) of the nodes (_block, _node, columns, _n) that others resemble, or that are several rows.

    A group is a connected component, named by its least node; its score is its best pair's, or 100 if a node has several
    rows. Each task links what it compares; only nodes of blocks in several tiles then need a search over tables.
    """
    used = _used(columns, weights)
    placed, large = _tiled(nodes, [*columns, "_n"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole(batches):
            yield _linked(frame, compare(frame, used, threshold, scorer, rounded))[["_block", *columns, "_node", "_group", "_score"]]

    texts = ", ".join(f"{c} string" for c in ["_block", *columns])
    linked = cut(placed.mapInPandas(run, f"{texts}, _node long, _group long, _score double"))
    if not large.limit(1).count():
        return linked.drop("_node")
    comp = components(linked.select(F.col("_group").alias("src"), F.col("_node").alias("dst")))
    known = linked.join(comp, linked["_node"] == comp["node"]).select("_block", *columns, F.col("component").alias("_group"), "_score")
    best = known.groupBy("_group").agg(F.max("_score").alias("_score"))
    return known.drop("_score").distinct().join(best, "_group").select("_block", *columns, "_group", "_score")


def _used(columns: list[str], weights: list[float]) -> list[tuple[str, float]]:
    return sorted(((c, float(w)) for c, w in zip(columns, weights) if w > 0), key=lambda x: -x[1])


def _linked(frame: pd.DataFrame, found: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The frame's nodes in some pair, or of several rows, with the least node and the best score of their component."""
    best = {v: 100.0 for v in frame.loc[frame["_n"] > 1, "_node"].tolist()}
    up = {v: v for v in best}

    def top(v: int) -> int:
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    for pair in found:
        for x, y, s in zip(pair["src"].tolist(), pair["dst"].tolist(), pair["score"].tolist()):
            a, b = sorted((top(up.setdefault(x, x)), top(up.setdefault(y, y))))
            best[a] = max(best.get(a, s), best.pop(b, s) if a != b else s, s)
            up[b] = a
    held = frame[frame["_node"].isin(up)]
    tops = [top(v) for v in held["_node"].tolist()]
    return held.assign(_group=np.array(tops, dtype=np.int64), _score=np.array([best[v] for v in tops], dtype=float))


class _Texts:
    """One column's texts as the scorer sees them: lengths, letters, and two bits for each of 32 letter classes.

    An inserted or deleted letter changes one bit at most, so bits that differ never outnumber the changes.
    """

    def __init__(self, raw: list[str], scorer: str):
        self.raw = raw
        self.texts = raw if scorer == "ratio" else [v.strip().lower() for v in raw]
        self.tokens = [frozenset(t.split()) for t in self.texts] if scorer == "token_set" else None
        seen = [" ".join(t) for t in self.tokens] if self.tokens is not None else self.texts
        self.length = np.array([len(t) for t in seen], dtype=np.int64)
        flat = np.frombuffer("".join(seen).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        rows = np.repeat(np.arange(len(seen)), self.length)
        blank = np.zeros(int(flat.max(initial=0)) + 1, dtype=bool)
        blank[[u for u in np.flatnonzero(np.bincount(flat)).tolist() if chr(u).isspace()]] = True
        ink = ~blank[flat]  # blanks are not counted: sorted tokens are joined by single ones
        counts = np.bincount(rows[ink] * 32 + flat[ink] % 32, minlength=32 * len(seen)).reshape(-1, 32)
        self.counts = np.minimum(counts, 1_000).astype(np.int16)
        self.inked = self.counts.sum(axis=1, dtype=np.int64)
        low, high = (np.packbits(counts > k, axis=1).view(np.uint32)[:, 0].astype(np.uint64) for k in (0, 1))
        self.bits = low | high << np.uint64(32)
        self.words = self.whole = self.repeats = None
        if scorer == "hybrid":
            # Of the distinct tokens, each with its blank: letters in each of 16 classes of tokens, and in all.
            tokens = [frozenset(t.split()) for t in self.texts]
            row = np.repeat(np.arange(len(raw)), [len(t) for t in tokens])
            size = np.array([len(x) + 1 for t in tokens for x in t], dtype=np.int64)
            kind = np.array([hash(x) & 15 for t in tokens for x in t], dtype=np.int64)
            self.words = np.bincount(row * 16 + kind, size, minlength=16 * len(raw)).reshape(-1, 16).astype(np.int32)
            self.whole = self.words.sum(axis=1)
            self.repeats = np.array([len(set(w)) < len(w) for w in (t.split() for t in self.texts)], dtype=bool)

    def sort(self, order: np.ndarray) -> None:
        at = order.tolist()
        self.raw, self.texts = [self.raw[k] for k in at], [self.texts[k] for k in at]
        self.tokens = [self.tokens[k] for k in at] if self.tokens is not None else None
        self.length, self.counts, self.inked, self.bits = self.length[order], self.counts[order], self.inked[order], self.bits[order]
        if self.words is not None:
            self.words, self.whole, self.repeats = self.words[order], self.whole[order], self.repeats[order]


def compare(frame: pd.DataFrame, used: list[tuple[str, float]], threshold: float, scorer: str, rounded: bool) -> Iterator[pd.DataFrame]:
    """The pairs of whole groups (_block, _i, _j). used: columns and weights, the heaviest first."""
    least, total = threshold - (0.5 if rounded else 0.0), sum(w for _, w in used)
    group = (frame[["_block", "_i", "_j"]] != frame[["_block", "_i", "_j"]].shift()).any(axis=1).cumsum().to_numpy()
    texts = [_Texts(frame[c].tolist(), scorer) for c, _ in used]
    order = np.lexsort((texts[0].length, group))
    frame, group = frame.iloc[order], group[order]
    for t in texts:
        t.sort(order)
    node, side = frame["_node"].to_numpy(), ((frame["_t"] == frame["_j"]) & (frame["_i"] < frame["_j"])).to_numpy()
    apart = (frame["_i"] < frame["_j"]).to_numpy()
    weights = [w for _, w in used]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    need = (least * total - 100 * (total - weights[0])) / weights[0]
    if scorer == "token_set" and need > _EPS:
        found = _by_tokens(texts[0], group, starts, ends, need)
    else:
        found = _by_letters(texts, weights, BY_LETTERS[scorer], total * (100 - least), starts, ends)
    for i, j in found:
        ok = (i != j) & (~apart[i] | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        for words in {"hybrid": (False, True), "ratio": (False,)}.get(scorer, ()):
            ok = _bound(texts, weights, scorer, words, i, j) >= least * total - _EPS
            i, j = i[ok], j[ok]
        i, j, s = _scored(texts, weights, scorer, threshold, least, total, rounded, i, j)
        if len(i):
            yield pd.DataFrame({"src": node[i], "dst": node[j], "score": s})


def _by_letters(texts: list[_Texts], weights: list[float], share: float, slack: float, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of a group whose differing letters do not yet cost more than the slack."""
    lengths, held, n = [np.maximum(t.length, 1).astype(np.float32) for t in texts], [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        step = max(1, AT_ONCE // 8 // (b - a))
        for r in range(a, b - 1, step):
            e = min(r + step, b)
            cost = np.zeros((e - r, b - r), dtype=np.float32)
            for t, w, ln in zip(texts, weights, lengths):
                cost += np.bitwise_count(t.bits[r:e, None] ^ t.bits[None, r:b]) * (np.float32(w * share) / (ln[r:e, None] + ln[None, r:b]))
            i, j = np.nonzero(cost <= slack + 1e-3)
            up = i < j
            held.append((i[up] + r, j[up] + r))
            n += len(held[-1][0])
            if n >= AT_ONCE // 8:
                yield tuple(map(np.concatenate, zip(*held)))
                held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _bound(texts: list[_Texts], weights: list[float], scorer: str, words: bool, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """No less than the weighted sum of the scores: by the letters that each side lacks, and by the shared words."""
    out = np.zeros(len(i))
    for t, w in zip(texts, weights):
        apart = np.abs(t.counts[i] - t.counts[j]).sum(axis=1, dtype=np.int16).astype(np.int64)
        more = (apart + t.inked[i] - t.inked[j]) // 2
        fewer = apart - more
        a, b = t.length[i], t.length[j]
        alike = 100 * (1 - (more + fewer) / np.maximum(a + b, 1))
        if scorer == "hybrid":
            n, lacks = np.minimum(a, b), np.where(a < b, more, np.where(a > b, fewer, np.minimum(more, fewer)))
            partial = np.where(n > 0, 200 * (n - lacks) / np.maximum(2 * n - lacks, 1), 100)
            tokens = 100.0
        if scorer == "hybrid" and words:
            # The token set score: by the letters, or by the tokens in common against all of the text that has fewer.
            shared, fewest = np.minimum(t.words[i], t.words[j]).sum(axis=1), np.minimum(t.whole[i], t.whole[j])
            changed = np.where(t.repeats[i] | t.repeats[j], 100.0, 100 * (1 - (more + fewer) / np.maximum(t.whole[i] + t.whole[j] - 2, 1)))
            tokens = np.where((shared >= fewest) | (a == 0) & (b == 0), 100.0, np.maximum(changed, 200 * shared / np.maximum(shared + fewest, 1)))
        if scorer == "hybrid":
            alike = 0.35 * tokens + 0.45 * alike + 0.20 * partial
        out += w * alike
    return out


def _by_tokens(t: _Texts, group: np.ndarray, starts: np.ndarray, ends: np.ndarray, need: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that can reach `need` by the token set score: through few changed letters, or as a part of the other's tokens.

    The second way allows a text few letters outside the shared tokens, so tokens longer than these are all shared.
    """
    r, held, n = need / 100, [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        ln = t.length[a:b]
        if b - a < 2 or (1 - r) * 2 * ln[-1] < 1 - _EPS:
            continue  # the shortest change costs more
        step = max(1, min(256, AT_ONCE // 8 // (b - a)))
        for x in range(a, b - 1, step):
            e = min(x + step, b)
            far = a + int(np.searchsorted(ln, t.length[e - 1] * (2 - r) / r + _EPS, "right"))
            most = (1 - r) * (t.length[e - 1] + t.length[far - 1]) + _EPS
            i, j = np.nonzero(np.bitwise_count(t.bits[x:e, None] ^ t.bits[None, x:far]) <= min(int(most), 64))
            i, j = i[up := i < j] + x, j[up] + x
            d = np.abs(t.counts[i] - t.counts[j]).sum(axis=1)
            ok = d <= (1 - r) * (t.length[i] + t.length[j]) + _EPS
            held.append((i[ok], j[ok]))
            n += len(held[-1][0])
            if n >= AT_ONCE // 8:
                yield tuple(map(np.concatenate, zip(*held)))
                held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))
    c = 2 / r - 2
    outside = np.maximum((c * (t.length - 1) - 1) / (1 + c) + _EPS, 0)
    many = np.array([len(x) for x in t.tokens])
    row, flat = np.repeat(np.arange(len(many)), many), [x for tokens in t.tokens for x in tokens]
    code = pd.factorize(np.array([*flat, ""], dtype=object))[0][:-1].astype(np.int64)
    size = np.array([len(x) for x in flat], dtype=np.int64)
    _, key, often = np.unique(group[row].astype(np.int64) * (code.max(initial=0) + 1) + code, return_inverse=True, return_counts=True)
    first = np.r_[0, np.cumsum(often)]
    holders = row[np.argsort(key, kind="stable")]
    sure = size > outside[row]
    # Of each text the rarest token that a partner must have; all of these must be among the other's, by one bit for each.
    bit = np.uint64(1) << (code % 64).astype(np.uint64)
    has, must = np.zeros(len(many), dtype=np.uint64), np.zeros(len(many), dtype=np.uint64)
    np.bitwise_or.at(has, row, bit)
    np.bitwise_or.at(must, row[sure], bit[sure])
    best = np.lexsort((often[key[sure]], row[sure]))
    rows, at = np.unique(row[sure][best], return_index=True)
    keys = key[sure][best][at]
    none = np.setdiff1d(np.arange(len(many)), rows)  # without such a token, a text meets its whole group
    place = np.searchsorted(starts, none, "right") - 1
    for who, lo, hi, of in ((rows, first[keys], first[keys + 1], holders), (none, starts[place], ends[place], np.arange(len(many)))):
        upto = np.cumsum(hi - lo)
        k = 0
        while k < len(who):
            m = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + AT_ONCE, "right")))
            w = hi[k:m] - lo[k:m]
            i = np.repeat(who[k:m], w)
            j = of[np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(lo[k:m], w)]
            ok = (must[i] & ~has[j]) == 0
            both = np.unique(np.minimum(i[ok], j[ok]) * len(many) + np.maximum(i[ok], j[ok]))
            yield both // len(many), both % len(many)
            k = m


def _scored(texts: list[_Texts], weights: list[float], scorer: str, threshold: float, least: float, total: float, rounded: bool, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs at or above the threshold and their scores."""
    f, kept, scores = scorers.SCORERS[scorer], [], []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        got, rest = 0.0, total
        for t, w in zip(texts, weights):  # a pair is given up once the other columns' best cannot save it
            rest -= w
            a, b = t.raw[x], t.raw[y]
            got += w * (100.0 if a == b else f(a, b, (least * total - got - 100 * rest) / w))
            if got + 100 * rest < least * total - 1e-9:
                break
        else:
            s = float(round(got / total)) if rounded else got / total
            if s >= threshold:
                kept.append(k)
                scores.append(s)
    return i[kept], j[kept], np.array(scores)
