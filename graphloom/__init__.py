"""graphloom: metadata-graph analytics expressed as Spark DataFrame plans."""
