"""Writers: CSV, partitioned corpora, converted tree, published corpus."""
