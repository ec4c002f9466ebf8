"""docweave: document analytics expressed as Spark DataFrame operators."""
