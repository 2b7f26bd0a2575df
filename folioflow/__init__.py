"""folioflow: document extraction and validation as Spark DataFrame plans."""
