"""Part of versoflow."""
