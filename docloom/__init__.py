"""docloom: document analytics as Spark DataFrame transformations."""
