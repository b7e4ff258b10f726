"""pagewright: document-image and corpus analytics expressed as Spark DataFrame plans."""
