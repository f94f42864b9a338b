"""Part of flowharbor."""
