"""docloom: document analytics expressed as Spark plans."""
