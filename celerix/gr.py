"""Graphs of points in space and statistics on them."""

from celerix.operators.spatial import calculate_niche, co_occurrence, ligrec, spatial_autocorr, spatial_neighbors, spatial_neighbors_delaunay, spatial_neighbors_grid, spatial_neighbors_knn, spatial_neighbors_radius

__all__ = ["calculate_niche", "co_occurrence", "ligrec", "spatial_autocorr", "spatial_neighbors", "spatial_neighbors_delaunay", "spatial_neighbors_grid", "spatial_neighbors_knn", "spatial_neighbors_radius"]
