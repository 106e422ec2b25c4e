"""quernstone: decision analytics over rules, graphs, change feeds and documents, as Spark DataFrames."""
