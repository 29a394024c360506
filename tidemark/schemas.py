"""Explicit schemas, as DDL: nothing is inferred, as inference would turn company keys into numbers."""

from __future__ import annotations

FACTS = (
    "cik string, taxonomy string, tag string, unit string, period_type string, period_start date, period_end date, period_year int, val double, fy int, fp string, form string, filed date, accn string, frame string"
)
FILINGS = ("cik string, accession string, form string, filing_date date, report_date date, primary_document string, is_xbrl boolean")
COMPANIES = ("ordinal int, ticker string, cik string, company_name string, company_group string, lender boolean")
CONCEPTS = ("concept string, concept_label string, applies_to string, unit string, period_type string, tag_rank int, tag string")
MANIFEST = (
    "chunk_id string, cik string, ticker string, accession string, form string, period_end date, fiscal_year int, items array<string>, section_path string, document_name string, char_start bigint, char_end bigint, text string, text_sha256 string, digest string, model string"
)
VECTORS = ("digest string, vector array<float>, part_no int")
SPANS = ("question string, accession string, char_start bigint, char_end bigint, grade int, document string, source string, filing_sha256 string, labelled_on date")

#: One observation of the nested JSON of tagged facts. ``val`` is read as text, so that a wrong type is seen.
_OBSERVATION = "struct<start:string,end:string,val:string,accn:string,fy:string,fp:string,form:string,filed:string,frame:string>"
COMPANY_FACTS_MAP = f"map<string,map<string,struct<label:string,units:map<string,array<{_OBSERVATION}>>>>>"
COMPANY_FACTS = f"cik bigint, entityName string, facts {COMPANY_FACTS_MAP}"
_COLUMNS = "accessionNumber array<string>, form array<string>, filingDate array<string>, reportDate array<string>, primaryDocument array<string>, isXBRL array<int>"
SUBMISSIONS = (
    f"cik string, filings struct<recent:struct<{_COLUMNS.replace(' array', ':array')}>,files:array<struct<name:string,filingCount:int,filingFrom:string,filingTo:string>>>"
)
SUBMISSIONS_PAGE = (_COLUMNS)
EVAL_COLUMNS = "question archetype split mode chunker strategy labelled recall_5 recall_10 reciprocal_rank ndcg_10 unjudged_10 issuers_10 coverage_10 hits".split()


def names(schema: str) -> list[str]:
    """The top-level columns of a schema."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[start:i].split()[0])
            start = i + 1
    return out
