"""Training-data operators: text in, decisions and artefacts out."""
