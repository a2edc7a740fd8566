"""DataFrame operators of the concept layer, the identifier layer and the role layer."""
