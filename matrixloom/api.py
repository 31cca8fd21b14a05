"""The public names a user of the reference knows, with its argument spellings, mapped to the operators.

Every name here is the function of the module it comes from; only the spelling of names and of the
arguments differs (``exprs_values`` or ``assay.type`` for ``assay_type``, ``color_by`` for ``colour_by``, ...).
Names that contain a project's or a class's name are neutral here: ``plotLibraryShares``, ``toBundle``,
``updateLegacy``, ``mockBundle``.
"""

from __future__ import annotations

import functools

from .bundle import Bundle
from .operators import counts as _c
from .operators import decompose as _d
from .operators import embed as _e
from .operators import explained as _x
from .operators import frames as _f
from .operators import grouped as _g
from .operators import retrieve as _r
from .sources import io as _s

# Other spellings of arguments.
SPELLINGS = {
    "exprs_values": "assay_type", "assay.type": "assay_type", "by_exprs_values": "assay_type", "by.assay.type": "assay_type",
    "color_by": "colour_by", "columns": "cells", "subset_row": "features", "subset_col": "cells", "colour_cells_by": "colour_by",
    "color_cells_by": "colour_by", "nvars_to_plot": "n", "npcs_to_plot": "npcs", "feature": "features", "nmad": "nmads", "altexp_exprs_values": "altexp_assay_type", "altexp.assay.type": "altexp_assay_type", "feature_names_to_plot": "feature_names",
    "summary_fun": "summary", "percentVar": "percent_var",
}


def _spelt(f):
    @functools.wraps(f)
    def call(*args, **kw):
        return f(*args, **{SPELLINGS.get(k, k): v for k, v in kw.items()})

    return call


_NAMES = {
    # accessors and lookup
    "retrieveCellInfo": _r.retrieve_cell_info, "retrieveFeatureInfo": _r.retrieve_feature_info, "annotateBMFeatures": _r.annotate_features, "getBMFeatureAnnos": _r.append_annotation,
    "bootstraps": Bundle.bootstraps, "fpkm": Bundle.fpkm, "norm_exprs": Bundle.norm_exprs, "stand_exprs": Bundle.stand_exprs, "exprs": Bundle.exprs,
    "setBootstraps": Bundle.set_bootstraps, "setFpkm": Bundle.set_fpkm, "setNormExprs": Bundle.set_norm_exprs, "setStandExprs": Bundle.set_stand_exprs, "setExprs": Bundle.set_exprs,
    "toBundle": _s.from_legacy, "updateLegacy": _s.from_legacy, "readSparseCounts": _s.read_sparse_counts, "mockBundle": _s.mock_bundle,
    "ggcells": _r.per_cell_frame, "cellsForMapping": _r.cells_for_mapping, "ggfeatures": _r.per_feature_frame, "makePerCellDF": _r.per_cell_frame, "makePerFeatureDF": _r.per_feature_frame,
    # counts
    "nexprs": _c.nexprs, "addPerCellQC": _c.add_per_cell_qc, "addPerFeatureQC": _c.add_per_feature_qc, "perCellQCMetrics": _c.per_cell_qc, "perFeatureQCMetrics": _c.per_feature_qc,
    "quickPerCellQC": _c.quick_per_cell_qc, "isOutlier": _c.is_outlier, "aggregateAcrossCells": _c.aggregate_across_cells, "aggregateAcrossFeatures": _c.aggregate_across_features,
    "sumCountsAcrossCells": _c.sum_across_cells, "sumCountsAcrossFeatures": _c.sum_across_features, "numDetectedAcrossCells": _c.num_detected_across_cells, "numDetectedAcrossFeatures": _c.num_detected_across_features,
    "calculateAverage": _c.calculate_average, "calculateCPM": _c.calculate_cpm, "calculateFPKM": _c.calculate_fpkm, "calculateTPM": _c.calculate_tpm,
    "librarySizeFactors": _c.library_size_factors, "medianSizeFactors": _c.median_size_factors, "computeLibraryFactors": _c.compute_library_factors, "computeMedianFactors": _c.compute_median_factors,
    "normalizeCounts": _c.normalize_counts, "logNormCounts": _c.log_norm_counts, "uniquifyFeatureNames": _c.uniquify_feature_names,
    # explained variance
    "getVarianceExplained": _x.get_variance_explained, "getExplanatoryPCs": _x.get_explanatory_pcs, "plotExplanatoryVariables": _x.explanatory_variables, "plotExplanatoryPCs": _x.explanatory_pcs,
    # embeddings
    "calculatePCA": _d.calculate_pca, "runPCA": _d.run_pca, "runColDataPCA": _d.run_coldata_pca, "calculateMDS": _d.calculate_mds, "runMDS": _d.run_mds, "calculateNMF": _d.calculate_nmf, "runNMF": _d.run_nmf,
    "calculateTSNE": _e.calculate_tsne, "runTSNE": _e.run_tsne, "calculateUMAP": _e.calculate_umap, "runUMAP": _e.run_umap, "calculateMultiUMAP": _e.calculate_multi_umap, "runMultiUMAP": _e.run_multi_umap,
    "projectReducedDim": _e.project_reduced_dim, "calculateDiffusionMap": _d.calculate_diffusion_map, "runDiffusionMap": _d.run_diffusion_map,
    # frames behind plots
    "plotColData": _f.col_data, "plotRowData": _f.row_data, "plotExpression": _f.expression, "plotDots": _g.dots, "plotGroupedHeatmap": _g.grouped_heatmap, "plotHeatmap": _f.heatmap,
    "plotHighestExprs": _f.highest_exprs, "plotLibraryShares": _f.library_shares, "plotRLE": _f.rle, "plotPlatePosition": _f.plate_position, "plotReducedDim": _f.reduced_dim, "plotPCA": _f.pca_frame,
    "plotTSNE": _f.tsne_frame, "plotUMAP": _f.umap_frame, "plotMDS": _f.mds_frame, "plotNMF": _f.nmf_frame, "plotDiffusionMap": _f.diffusion_map_frame,
    # defunct
    "calculateQCMetrics": _d.calculate_qc_metrics, "normalize": _d.normalize, "centreSizeFactors": _d.centre_size_factors, "multiplot": _d.multiplot,
}
globals().update({name: _spelt(f) for name, f in _NAMES.items()})
__all__ = sorted(_NAMES)
