"""quillgrove: a PySpark analytics library for conversational-memory and text data."""
