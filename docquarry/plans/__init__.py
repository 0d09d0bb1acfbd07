"""Plans: operators composed into indexing and answering."""
