"""Form packs: the printed labels of public solicitation and order forms, as data for geometric_fields().

A line is a field; what stands before the colon says where its value is: b below, r right, rb right, else below, m a mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ANCHORS = {"b": ("Text", "Below"), "r": ("Text", "Right"), "rb": ("Text", "RightThenBelow"), "m": ("Checkbox", "Mark")}

US_FEDERAL = """
= SF-33 solicitation
b: SOLICITATION NUMBER | solicitation_number
b: DATE ISSUED | date_issued
r: ISSUED BY | issued_by_code
b: E-MAIL ADDRESS | info_call_email
m: SOLICITATION/CONTRACT FORM | toc_A
m: SUPPLIES OR SERVICES AND PRICE | toc_B
m: DESCRIPTION/SPECS | toc_C
m: PACKAGING AND MARKING | toc_D
m: INSPECTION AND ACCEPTANCE | toc_E
m: DELIVERIES OR PERFORMANCE | toc_F
m: CONTRACT ADMINISTRATION DATA | toc_G
m: SPECIAL CONTRACT REQUIREMENTS | toc_H
m: CONTRACT CLAUSES | toc_I
m: LIST OF ATTACHMENTS | toc_J
m: REPRESENTATIONS, CERTIFICATIONS | toc_K
m: NOTICES TO OFFERORS | toc_L
m: EVALUATION FACTORS FOR AWARD | toc_M
= SF-30 amendment
b: AMENDMENT/MODIFICATION NO | amendment_number
b: EFFECTIVE DATE | effective_date
r: ISSUED BY | issued_by_code
b: AMENDMENT OF SOLICITATION NO | amended_solicitation
m: IS EXTENDED | offers_extended
m: IS REQUIRED TO SIGN | contractor_must_sign
b: NAME AND TITLE OF SIGNER | signer_name
b: NAME AND TITLE OF CONTRACTING OFFICER | contracting_officer
= SF-1449 commercial
b: SOLICITATION NUMBER | solicitation_number
b: SOLICITATION ISSUE DATE | solicitation_issue_date
b: REQUISITION NO | requisition_number
rb: OFFER DUE DATE | offer_due_date
r: NAICS | naics
b: SIZE STANDARD | size_standard
m: SET ASIDE | set_aside
= SF-18 RFQ
b: REQUEST NO | request_number
b: DATE ISSUED | date_issued
b: REQUISITION/PURCHASE REQUEST | requisition_number
b: ISSUED BY | issued_by
= SF-1442 construction
b: SOLICITATION NO | solicitation_number
b: DATE ISSUED | date_issued
b: CONTRACT NO | contract_number
b: PROJECT NO | project_number
b: ISSUED BY | issued_by
= SF-26 award
b: EFFECTIVE DATE | effective_date
b: REQUISITION/PURCHASE REQUEST | requisition_number
b: ISSUED BY | issued_by
b: ADMINISTERED BY | administered_by
= OF-347 order
b: DATE OF ORDER | date_of_order
b: CONTRACT NO | contract_number
b: ORDER NO | order_number
b: ISSUING OFFICE | issuing_office
= DD-1155 order
b: CONTRACT/PURCH. ORDER | contract_number
b: DELIVERY ORDER | order_number
b: DATE OF ORDER | date_of_order
b: ISSUED BY | issued_by
"""
US_VIRGINIA = """
= Commonwealth of Virginia RFP
rb: RFP NO | rfp_number
rb: ISSUE DATE | issue_date
rb: TITLE | title
rb: COMMODITY CODE | commodity_codes
b: ISSUING AGENCY | issuing_agency
rb: LOCATION | location
rb: PERIOD OF CONTRACT | period_of_contract
rb: QUESTIONS DUE | questions_due
"""
PACKS = {"us-federal": US_FEDERAL, "us-virginia": US_VIRGINIA}


def rows(*packs: str) -> list[tuple[str, int, int, str, str, str, str]]:
    """(profile, profile_idx, spec_idx, name, label, kind, anchor) of some packs, or of all."""
    out: list[tuple[str, int, int, str, str, str, str]] = []
    profile, p, i = "", -1, 0
    for line in "".join(PACKS[k] for k in packs or PACKS).strip().splitlines():
        if not line:
            continue
        if line.startswith("= "):
            profile, p, i = line[2:], p + 1, 0
            continue
        where, _, what = line.partition(": ")
        label, _, name = what.partition(" | ")
        out.append((profile, p, i, name, label, *ANCHORS[where]))
        i += 1
    return out


def profiles(spark: SparkSession, *packs: str) -> tuple[DataFrame, DataFrame]:
    """(specs, order of profiles), as geometric_fields() takes them."""
    every = spark.createDataFrame(rows(*packs), "profile string, profile_idx int, spec_idx int, name string, label string, kind string, anchor string")
    return every.drop("profile_idx"), every.select("profile", "profile_idx").distinct()
