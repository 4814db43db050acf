"""Code catalogues of many TypeScript projects as Spark DataFrames."""
