"""Transit tables and how they relate."""
