"""Analytics on time-ordered tables with the PySpark DataFrame API, and text-corpus operators in ``quern.llm``."""
