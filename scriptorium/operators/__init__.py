"""DataFrame operators: snapshots, postings, queries, ranking, tags."""
