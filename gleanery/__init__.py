"""News-corpus curation as Spark jobs: collect, store, summarise, de-duplicate, rank, deliver."""
