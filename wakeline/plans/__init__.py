"""The store: partitions, manifests and the session object over them."""
