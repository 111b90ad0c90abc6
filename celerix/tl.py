"""Tools: clustering, layouts, marker tests, scores."""

from celerix.operators.clustering import kmeans
from celerix.operators.decomposition import diffmap
from celerix.operators.graph import leiden, louvain
from celerix.operators.layout import draw_graph, tsne, umap
from celerix.operators.markers import embedding_density, filter_markers, rank_genes_groups, score_genes, score_genes_cell_cycle

__all__ = ["diffmap", "draw_graph", "embedding_density", "filter_markers", "kmeans", "leiden", "louvain", "rank_genes_groups", "score_genes", "score_genes_cell_cycle", "tsne", "umap"]
