"""Reading and writing: corpora, manifests, artifacts, token caches, configurations."""
