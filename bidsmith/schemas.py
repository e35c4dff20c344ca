"""Explicit schemas: nothing is inferred from files."""

AWARD = "title string, solicitation_number string, posted_date string, awardee_name string, awardee_name_raw string, awardee_duns string, award_amount double, agency string, office string, naics string, set_aside string, sole_source boolean, is_idiq boolean, description string, sam_url string"
TRAINING = "award_amount string, ticker string, ticker_confidence string, historical_market_cap_approx string, posted_date string, first_8k_date string, last_dilutive_filing_date string, dilutive_filing_type string, first_pr_date string, has_pr string, agency_prior_win_count string, is_first_agency_win string, sole_source string, agency string, naics string, awardee_name string"
SIGNAL = ("timestamp", "ticker", "awardee_name", "award_amount", "market_cap", "score", "breakdown", "agency", "posted_date")
OPPORTUNITY = "title string, solicitationNumber string, postedDate string, typeOfSetAsideDescription string, description string, archiveType string, fullParentPathName string, naicsCode string, award struct<amount: string, date: string, awardee: struct<name: string, ueiSAM: string>>, uiLink string"
CACHE = "key string, value string, expires_at double, set_at timestamp"
PRICE = "ticker string, trade_date date, open double, high double, low double, close double"

#: Report header to field.
REPORT_FIELDS = {
    "PIID": "piid", "CAGE Code": "cage_code", "Unique Entity ID": "uei", "Country of Incorporation": "country_of_incorporation", "Contractor Name": "contractor_name",
    "Legal Business Name": "legal_business_name", "Doing Business As Name": "dba_name", "Ultimate Parent Legal Business Name": "parent_name", "Ultimate Parent Unique Entity ID": "parent_uei",
    "Base and All Options Value (Total Contract Value)": "award_amount", "Period of Performance Start Date": "posted_date", "Contracting Agency Name": "agency", "NAICS Code": "naics_code",
    "NAICS Description": "naics_description", "Type of Set Aside Code": "set_aside_code", "Extent Competed Code": "extent_competed_code",
    "Other Than Full and Open Competition Code": "other_than_full_open", "IDV Type": "idv_type", "Number of Offers Received": "num_offers",
}
REPORT_FLAGS = {
    "Educational Institution": "is_educational", "Federal Agency": "is_federal_agency", "Airport Authority": "is_airport_authority", "Council Of Governments": "is_council_of_governments",
    "Community Development Corporation": "is_community_development_corp", "Federally Funded Research and Development Corporation": "is_federally_funded_rd",
}
