"""quillframe: declarative structured-data plans compiled to Spark DataFrames."""

__version__ = "0.1.0"
