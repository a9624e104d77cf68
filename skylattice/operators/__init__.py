"""DataFrame operators: lattice algebra, spatial joins, depth maps, mosaics, georeferencing."""
