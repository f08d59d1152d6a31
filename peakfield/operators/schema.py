"""Configurations of runs as JSON, one a row: a closed schema of sections, typed values with defaults, rules, and all errors of a row as a list.

A row with errors is not stopped: its errors tell what is wrong (no JSON object, keys that no run knows by their whole path, values of another type, broken
rules), and its values are the defaults where they could not be read. What runs is up to who reads the list.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Section, key, type and default (null: none) of all that a run can be told; no section stands for the top level.
KEYS = """
- input_mrc string ""
- micrographs_star string ""
- template_mrc string ""
- output_dir string "output"
- output_prefix string "match"
microscope voltage_kv double 300.0
microscope spherical_aberration_mm double 2.7
microscope amplitude_contrast double 0.07
microscope defocus1_angstrom double 10000.0
microscope defocus2_angstrom double 10000.0
microscope defocus_angle_deg double 0.0
microscope phase_shift_deg double 0.0
search pixel_size_angstrom double 1.0
search low_resolution_limit_angstrom double 300.0
search high_resolution_limit_angstrom double 8.0
search angular_step_deg double 5.0
search in_plane_step_deg double null
search symmetry string "C1"
search particle_radius_angstrom double 100.0
search template_padding double 1.0
search defocus_search_range_angstrom double 0.0
search defocus_step_angstrom double 50.0
search pixel_size_search_range_angstrom double 0.0
search pixel_size_step_angstrom double 0.02
search image_slice int 1
search apply_result_rescaling boolean false
search disable_flat_fielding boolean false
search expected_false_positives double 1.0
search threshold_override double null
search fraction_of_search_positions_independent double 1.0
search ignore_defocus_for_threshold boolean false
search minimum_peak_radius_angstrom double null
search maximum_peaks int 1000
search preserve_psi_360_duplicate boolean true
search mip_initial_value double 0.0
search fft_size_mode string "standard"
search max_search_size int 1024
search padding_mode string "noise"
search random_seed int 0
search statistics_roi_mode string "precompiled"
search statistics_roi_border_pixels int null
search threshold_pixel_mode string "full"
search allow_rotation_for_speed boolean false
runtime pixel_size_tolerance double 0.001
runtime max_pixel_resample_dimension int 1536
runtime orientation_batch_size int 32
runtime ccf_stack_mode string "none"
runtime ccf_stack_path string null
runtime first_orientation int 0
runtime last_orientation int null
runtime save_raw_accumulators boolean true
runtime histogram_mode string "exact"
runtime histogram_sample_orientation_stride int 16
runtime histogram_sample_pixel_stride int 4
weighting mode string "standard"
weighting kk double 3.0
weighting a double -9.32
weighting b double 2.65
weighting b2 double 0.01908
weighting bfactor double -78.7757
weighting bfactor2 double -12.9121
weighting bfactor3 double 1.28732
weighting cosine_edge_width_pixels double 8.0
weighting image_high_frequency_damping boolean true
weighting projection_whitening_epsilon double 1.0e-12
template source string "mrc"
template pdb_path string ""
template box_size int null
template pixel_size_angstrom double null
template resolution_angstrom double null
template center boolean true
template include_hetatm boolean false
template include_chains array<string> []
template exclude_chains array<string> []
template center_reference_json string null
template center_metadata_path string null
template generated_mrc_path string null
template reuse_generated boolean true
template y_flip boolean false
template atom_batch_size int 1024
batch micrograph_root string null
batch output_subdirectories boolean true
batch continue_on_error boolean false
batch write_resolved_configs boolean true
batch manifest_prefix string "batch"
batch first_micrograph int 0
batch last_micrograph int null
debug debug_dir string null
debug level int 0
debug save_npy boolean true
debug stop_after_stage int 0
debug single_orientation_phi_deg double null
debug single_orientation_theta_deg double null
debug single_orientation_psi_deg double null
timing enabled boolean false
timing mode string "sampled"
timing output_dir string null
timing warmup_batches int 5
timing sample_every_batches int 100
timing max_samples int 200
timing progress_every_batches int 0
timing print_summary boolean true
timing save_batch_samples boolean true
"""

#: What must hold, in SQL over section.key. Those of paths hold only where a run is to be started.
RULES = """
output_prefix != ''
microscope.voltage_kv > 0
microscope.spherical_aberration_mm >= 0
microscope.amplitude_contrast between 0 and 1
search.pixel_size_angstrom > 0
search.high_resolution_limit_angstrom > 0
search.low_resolution_limit_angstrom > 0
search.angular_step_deg >= 0
search.in_plane_step_deg is null or search.in_plane_step_deg > 0
search.particle_radius_angstrom >= 0
abs(search.template_padding - 1.0) <= 1.0e-6
search.defocus_search_range_angstrom >= 0
search.defocus_search_range_angstrom <= 0 or search.defocus_step_angstrom > 0
search.pixel_size_search_range_angstrom >= 0
search.pixel_size_search_range_angstrom <= 0 or search.pixel_size_step_angstrom > 0
search.expected_false_positives > 0
search.fraction_of_search_positions_independent > 0 and search.fraction_of_search_positions_independent <= 1
search.image_slice >= 1
search.maximum_peaks >= 0
search.max_search_size >= 8
search.fft_size_mode in ('standard', 'power2', 'exact')
search.padding_mode in ('noise', 'zero', 'edge', 'replicate')
search.statistics_roi_mode in ('source', 'precompiled', 'full')
search.statistics_roi_border_pixels is null or search.statistics_roi_border_pixels >= 0
search.threshold_pixel_mode in ('source', 'statistics', 'full')
runtime.pixel_size_tolerance > 0
runtime.max_pixel_resample_dimension >= 8
runtime.orientation_batch_size > 0
runtime.ccf_stack_mode in ('none', 'cpu', 'mrc')
runtime.first_orientation >= 0
runtime.last_orientation is null or runtime.last_orientation >= runtime.first_orientation
runtime.histogram_mode in ('exact', 'sampled', 'off')
runtime.histogram_sample_orientation_stride > 0
runtime.histogram_sample_pixel_stride > 0
weighting.mode in ('standard', 'weighted')
weighting.kk >= 0
weighting.cosine_edge_width_pixels > 0
weighting.projection_whitening_epsilon > 0
template.source in ('mrc', 'pdb')
template.source != 'pdb' or template.pdb_path != ''
template.source != 'pdb' or coalesce(template.box_size, 0) >= 8
template.source != 'pdb' or template.pixel_size_angstrom is null or template.pixel_size_angstrom > 0
template.source != 'pdb' or template.resolution_angstrom is null or template.resolution_angstrom > 0
template.atom_batch_size > 0
not arrays_overlap(template.include_chains, template.exclude_chains)
batch.manifest_prefix != ''
batch.first_micrograph >= 0
batch.last_micrograph is null or batch.last_micrograph >= batch.first_micrograph
debug.level >= 0
debug.stop_after_stage between 0 and 10
(debug.single_orientation_phi_deg is null) = (debug.single_orientation_theta_deg is null) and (debug.single_orientation_phi_deg is null) = (debug.single_orientation_psi_deg is null)
timing.mode in ('summary', 'sampled', 'synchronized')
timing.warmup_batches >= 0
timing.sample_every_batches > 0
timing.max_samples >= 0
timing.progress_every_batches >= 0
"""
PATH_RULES = """
input_mrc != '' or micrographs_star != ''
input_mrc = '' or micrographs_star = ''
template.source != 'mrc' or template_mrc != ''
"""


def sections() -> dict[str, dict[str, tuple[str, str]]]:
    """Section to key to type and default as JSON."""
    out: dict[str, dict[str, tuple[str, str]]] = {}
    for line in KEYS.strip().splitlines():
        section, key, kind, default = line.split(" ", 3)
        out.setdefault(section, {})[key] = (kind, default)
    return out


def rules(paths: bool = False) -> list[str]:
    return RULES.strip().splitlines() + (PATH_RULES.strip().splitlines() if paths else [])


def _value(raw: Column, kind: str) -> Column:
    """A value from its JSON text, or null where that is of another type. NaN and infinities are no numbers of JSON."""
    if kind == "string":
        return raw
    if kind == "boolean":
        return F.when(raw == "true", True).when(raw == "false", False)
    if kind.startswith("array"):
        return F.when(raw.startswith("["), F.from_json(raw, kind))
    return F.when(raw.rlike(r"^-?[0-9]+$" if kind == "int" else r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), raw.try_cast(kind))


def read(configs: DataFrame, text: str, paths: bool = False, config: str = "config", errors: str = "errors", overrides: dict[str, Column] | None = None) -> DataFrame:
    """configs with a struct of all sections and a sorted list of errors (empty: none). overrides: "section.key" to a column, which counts where it is not
    null before what the text says."""
    known, overrides = sections(), overrides or {}
    said = "map<string,string>"
    rows = configs.withColumn("_top", F.from_json(text, said))
    nested = [s for s in known if s != "-"]
    rows = rows.withColumns({f"_{s}": F.from_json(F.try_element_at("_top", F.lit(s)), said) for s in nested})
    wrong: list[Column] = [F.when(F.col("_top").isNull(), F.array(F.lit("no JSON object")))]
    unknown = lambda keys, names, path: F.transform(F.array_except(F.map_keys(keys), F.array(*[F.lit(n) for n in names])), lambda k: F.concat(F.lit(f"unknown key {path}"), k))
    wrong.append(unknown(F.col("_top"), [*known["-"], *nested], ""))
    built: dict[str, list[Column]] = {}
    for s, keys in known.items():
        source, path = F.col("_top" if s == "-" else f"_{s}"), "" if s == "-" else f"{s}."
        if s != "-":
            wrong.append(F.when(F.try_element_at("_top", F.lit(s)).isNotNull() & source.isNull(), F.array(F.lit(f"{s} is no object"))))
            wrong.append(unknown(source, list(keys), path))
        for k, (kind, default) in keys.items():
            raw = F.try_element_at(source, F.lit(k))
            own = _value(raw, kind)
            wrong.append(F.when(raw.isNotNull() & own.isNull(), F.array(F.lit(f"{path}{k} is no {kind}"))))
            absent = F.from_json(F.lit(default), kind) if kind.startswith("array") else F.lit(None if default == "null" else default.strip('"')).cast(kind)
            given = [overrides[path + k].cast(kind)] if path + k in overrides else []
            built.setdefault(s, []).append(F.coalesce(*given, own, absent).alias(k))
    whole = F.struct(*built["-"], *[F.struct(*built[s]).alias(s) for s in nested])
    rows = rows.withColumns({config: whole, errors: F.flatten(F.array_compact(F.array(*wrong)))})
    names = re.compile(r"(?<![\w.'])(" + "|".join([*[f"{s}(?=\\.)" for s in nested], *known["-"]]) + r")\b(?!')")
    broken = [F.when(~F.coalesce(F.expr(names.sub(rf"{config}.\1", r)), F.lit(False)), F.lit(f"not {r}")) for r in rules(paths)]
    rows = rows.withColumn(errors, F.array_sort(F.concat(errors, F.array_compact(F.array(*broken)))))
    return rows.drop("_top", *[f"_{s}" for s in nested])
