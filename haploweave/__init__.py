"""PySpark-native haplotype-network engine: alignments in, networks out, as DataFrames."""
