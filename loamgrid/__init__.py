"""loamgrid: data quality and master-data operators as Spark plans."""
