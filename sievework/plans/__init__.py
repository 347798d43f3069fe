"""Query plans over the engine's tables."""
