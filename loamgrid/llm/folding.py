"""Texts folded to the words a reader sees: look-alike letters, hidden signs, digits and signs written for letters."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that look like Latin ones, and the letters they look like.
LOOK_ALIKE = str.maketrans(
    "аеоорсхуіјѕԁһԛԝкмтвнАЕОРСХУІЈЅКМТВНαοερνικτυχωϲΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑɡℓ",
    "aeoopcxyijsdhqwkmtbhAEOPCXYIJSKMTBHaoepviktuxwcABEZHIKMNOPTYXiagl",
)
HIDDEN = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
# Signs and digits that people type for letters.
LEET = str.maketrans("013457!$@", "oieastisa")


def fold(text: str) -> str:
    """The text in lower case, compatibility forms resolved, hidden signs and accents' marks gone, look-alikes replaced."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", HIDDEN.sub("", text)).translate(LOOK_ALIKE).lower()
    return "".join(ch for ch in unicodedata.normalize("NFD", text) if not unicodedata.combining(ch))
