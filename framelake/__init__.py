"""framelake: Spark jobs for video episodes, masks, patch features and feature caches."""

__version__ = "0.1.0"
