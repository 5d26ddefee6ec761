"""Text structuring, normalisation, alignment and packaging as Spark DataFrame operators."""
