"""Preprocessing: every function takes an AnnFrame and returns a new one (or the result, where said)."""

from celerix.operators.decomposition import harmony_integrate, pca, scrublet
from celerix.operators.features import highly_variable_genes
from celerix.operators.neighbors import bbknn, neighbors
from celerix.operators.qc import calculate_qc_metrics, filter_cells, filter_genes, flag_gene_family
from celerix.operators.transform import log1p, normalize_pearson_residuals, normalize_total, regress_out, scale
from celerix.sources.store import materialize, write_obsm

__all__ = ["bbknn", "calculate_qc_metrics", "filter_cells", "filter_genes", "flag_gene_family", "harmony_integrate", "highly_variable_genes", "log1p", "materialize", "neighbors", "normalize_pearson_residuals", "normalize_total", "pca", "regress_out", "scale", "scrublet", "write_obsm"]
