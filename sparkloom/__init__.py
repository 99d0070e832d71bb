"""sparkloom: an analytics engine that is declared on Spark DataFrames and SQL."""
