"""helixframe: sequence and corpus analytics expressed as Spark DataFrame plans."""
