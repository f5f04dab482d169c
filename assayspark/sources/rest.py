"""Addresses of a REST service of analyses: checked on the driver one by one, or made for a whole table of ids."""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayspark.functions.columns import full_id, id_kind

# What each context takes and gives.
INPUTS = {
    "study": ("study_id", "study_title", "institute", "last_name", "analysis_id", "metabolite_id"),
    "compound": ("regno", "formula", "inchi_key", "lm_id", "pubchem_cid", "hmdb_id", "kegg_id", "chebi_id", "metacyc_id", "abbrev"),
    "refmet": ("all", "match", "name", "inchi_key", "regno", "pubchem_cid", "formula", "main_class", "sub_class"),
    "gene": ("mgp_id", "gene_id", "gene_name", "gene_symbol", "taxid"),
    "protein": ("mgp_id", "gene_id", "gene_name", "gene_symbol", "taxid", "mrna_id", "refseq_id", "protein_gi", "uniprot_id", "protein_entry", "protein_name"),
}
OUTPUTS = {
    "study": ("summary", "factors", "analysis", "metabolites", "source", "species", "disease", "number_of_metabolites", "data", "datatable", "untarg_studies", "untarg_factors", "untarg_data"),
    "compound": ("all", "regno", "formula", "exactmass", "inchi_key", "name", "sys_name", "smiles", "lm_id", "pubchem_cid", "hmdb_id", "kegg_id", "chebi_id", "metacyc_id", "classification", "molfile", "png"),
    "refmet": ("all", "name", "inchi_key", "regno", "pubchem_cid", "exactmass", "formula", "synonyms", "sys_name", "main_class", "sub_class"),
    "gene": ("all", "lmp_id", "mgp_id", "gene_name", "gene_symbol", "gene_synonyms", "alt_names", "chromosome", "map_location", "summary", "taxid", "species", "species_long"),
    "protein": ("all", "mgp_id", "gene_id", "gene_name", "gene_symbol", "taxid", "species", "species_long", "mrna_id", "refseq_id", "protein_gi", "uniprot_id", "protein_entry", "protein_name", "seqlength", "seq", "is_identical_to"),
}
ID_FORMS = {
    "study_id": r"ST[0-9]{0,6}", "analysis_id": r"AN[0-9]{6}", "metabolite_id": r"ME[0-9]{6}", "inchi_key": r"[A-Z,\-]{27}", "lm_id": r"LM[A-Z]{2}[0-9]{8,10}",
    "hmdb_id": r"HMDB[0-9]+", "kegg_id": r"CO[0-9]+", "mgp_id": r"MGP[0-9]{6}", "mrna_id": r"NM_[0-9]+", "refseq_id": r"NP_[0-9]+",
    "regno": r"\d+", "pubchem_cid": r"\d+", "chebi_id": r"\d+", "gene_id": r"\d+", "taxid": r"\d+", "protein_gi": r"\d+",
    "uniprot_id": r"([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2}).*",
}
DATABASES = ("LIPIDS", "MB", "REFMET")
MOVERZ, TOLERANCE = (50, 2000), (0.0001, 1)


def url(base: str, context: str, input_item: str, input_value: str, output_item: str | list[str], output_format: str | None = None, more: Collection[str] = ()) -> str:
    """An address of one of the contexts in INPUTS; a ValueError says which part is wrong. more: further output items."""
    if context not in INPUTS:
        raise ValueError(f"Unknown context {context}")
    if input_item not in INPUTS[context]:
        raise ValueError(f"{context} has no input item {input_item}")
    if input_item in ID_FORMS and not re.fullmatch(ID_FORMS[input_item], input_value):
        raise ValueError(f"{input_value} is no {input_item}")
    items = [output_item] if isinstance(output_item, str) else output_item
    if context == "study" and len(items) > 1:
        raise ValueError("study takes a single output item")
    if wrong := [x for x in items if x not in OUTPUTS[context] and x not in more]:
        raise ValueError(f"{context} has no output items {', '.join(wrong)}")
    return base + "/".join([context, input_item, input_value, ",".join(items), *([output_format] if output_format else [])])


def moverz_url(base: str, database: str, moverz: float, ion: str, tolerance: float, ions: Collection[str] | None = None) -> str:
    """An address of a search by mass; ions: those that are known, where they are to be checked."""
    if database not in DATABASES:
        raise ValueError(f"Unknown database {database}")
    if not MOVERZ[0] <= float(moverz) <= MOVERZ[1] or not TOLERANCE[0] <= float(tolerance) <= TOLERANCE[1]:
        raise ValueError("The mass or its tolerance is out of range")
    if ions is not None and ion not in ions:
        raise ValueError(f"Unknown ion type {ion}")
    return base + "/".join(["moverz", database, str(moverz), ion, str(tolerance), "txt"])


def exactmass_url(base: str, lipid: str, ion: str, lipids: Collection[str] | None = None, ions: Collection[str] | None = None) -> str:
    """An address of a lipid's exact mass; lipids and ions: those that are known, where they are to be checked."""
    if lipids is not None and not any(x in lipid for x in lipids):
        raise ValueError(f"Unknown lipid {lipid}")
    if ions is not None and ion not in ions:
        raise ValueError(f"Unknown ion type {ion}")
    return base + "/".join(["exactmass", lipid, ion])


def document_urls(base: str, raw_id: Column, item: str, extension: str = "txt") -> Column:
    """The addresses of analyses or studies by their ids; digits alone are an analysis. Other values give null.
    item: the service's name for whole documents."""
    known = full_id(raw_id).rlike(r"^(AN\d{6,}|ST\d{1,6})$")
    kind = F.when(full_id(raw_id).startswith("ST"), "study_id").otherwise(F.concat(id_kind(raw_id), F.lit("_id")))
    return F.when(known, F.concat(F.lit(f"{base}study/"), kind, F.lit("/"), full_id(raw_id), F.lit(f"/{item}/{extension}")))


def study_analyses(rows: DataFrame) -> DataFrame:
    """study_id and its analyses, from rows(study_id, analysis_id)."""
    return rows.groupBy("study_id").agg(F.sort_array(F.collect_set("analysis_id")).alias("analyses"))
