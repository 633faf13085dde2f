"""Named queries and the engine's surface."""
