"""quern: a PySpark library for building, searching and cleaning a corpus of articles."""
