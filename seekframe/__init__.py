"""seekframe: explainable retrieval analytics as DataFrame plans."""
