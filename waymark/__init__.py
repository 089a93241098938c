"""waymark: multimodal accessibility analytics expressed as Spark DataFrame plans."""
