"""Training-data operators: token counts, URL filters, binary output, decontamination, secrets, packing, near-duplicates,
toxicity, WARC revisits, n-gram joins, vector codes, SentencePiece ids and
periodic runs. Nothing else in the library imports this subpackage."""
