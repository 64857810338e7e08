"""corpusloom: lexical, link-analysis and corpus operators on PySpark DataFrames."""
