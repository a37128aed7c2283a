"""Rule tables of routing, headings, anchors and facts: defaults that a user can replace."""

from __future__ import annotations

# Vocabulary and patterns that results depend on.
LOCATION = [r"\bpage\s+(\d+)\b", r"\bp\.?\s*(\d+)\b", r"\bpages?\s+(\d+)\s*-\s*(\d+)\b"]
POINTER_TERMS = [r"\bwhere can i find\b", r"\bwhere is\b", r"\brefer to\b", r"\bwhich section\b", r"\bwhere is described\b"]
CLOSED_TERMS = [r"\bwhich matters\b", r"\bexplicitly closed\b", r"\bsettled\b", r"\bdiscontinued\b"]
COVERAGE_TERMS = [r"\blist all\b", r"\ball\s+\w+", r"\bprovide all\b", r"\bevery\b", r"\blitigation events\b", r"\blegal proceedings\b", r"\bsummarize section\b", r"\bitems of note\b", r"\bsignificant events\b"]
LIST_TERMS = [r"\blist\b", r"\ball\b", r"\beach\b"]
ATTRIBUTE_TERMS = [r"\brange\b", r"\baggregate\b", r"\btotal\b", r"\bamount\b", r"\bexposure\b", r"\bloss(?:es)?\b", r"\bliabilit(?:y|ies)\b"]
LITIGATION_TERMS = [r"\blitigation\b", r"\blegal proceedings\b", r"\bcontingent liabilities\b", r"\bnote\s*21\b", r"\bmatters?\b"]
LITIGATION_ANCHORS = ["Significant legal proceedings", "Contingent liabilities", "Note 21"]
EXPANSION = ["significant legal proceedings", "contingent liabilities", "Note 21", "litigation"]
SECTION_TARGETS = [("significant_events", r"\bsignificant events\b", "Significant events"), ("items_of_note", r"\bitems of note\b", "Items of note"), ("note_21", r"\bnote\s*21\b|\bsignificant legal proceedings\b", "Note 21")]
EXPLICIT_NOTE = [r"\bnote\s+\d+\b", "derivative instruments"]

POSITIVE = ["Items of note", "FDIC special assessment", "acquisition-related intangibles", "adjusted net income"]
NEGATIVE = ["Consolidated financial statements", "Derivative instruments"]
ADJUSTED = ["adjusted measures are non-gaap", "adjusted measures are used to assess", "adjusted measures are used to", "non-gaap", "common shareholders' equity divided by"]
AGGREGATE = ["aggregate impact", "net impact", "aggregate"]
REFERENCE_ONLY = ["for additional information", "for additional information and a reconciliation", "are adjusted to exclude", "adjusted to exclude the impact of items of note", "see the reconciliation", "see reconciliation", "reconciliation of reported results to adjusted"]
RATIO_TERMS = ["lcr", "ratio", "capital", "common shareholders' equity", "roe", "efficiency ratio"]
FRONT_MATTER = ["glossary", "definition", "refer to", "see section", "see the section", "see note", "see the note", "cross-reference"]
IMPACT = r"(?i)(?:\$|C\$|US\$)\s*[\d,.]+|[\d,.]+\s*(?:million|billion)"

HEADING_ONE = [r"\bMD&A\b", r"Management'?s Discussion and Analysis", r"^Note\s+\d+"]
HEADING_TWO = [r"\bSignificant events\b", r"\bItems of note\b", r"\bSignificant legal proceedings\b"]
BOILERPLATE = ["ANNUAL REPORT", "CONSOLIDATED FINANCIAL STATEMENTS"]

FACT_ALIASES = [("default_currency", ["default currency", "currency"]), ("reporting_period", ["reporting period", "year ended"]), ("accounting_framework", ["accounting framework", "ifrs", "gaap"]), ("units", ["units", "in millions", "in billions"]), ("consolidation_basis", ["consolidation basis", "consolidated"])]
FACT_HEADINGS = ["Consolidated financial statements", "Basis of presentation", "Significant accounting policies", "Presentation currency", "Functional currency"]
FACT_KEYWORDS = ["all amounts are in", "canadian dollars", "unless otherwise stated", "unless otherwise indicated", "presentation currency"]

CURRENCY = r"(?i)all amounts are in ([A-Za-z\s.]+?) (dollars|currency)"
UNITS = r"(?i)all amounts are in (?:[A-Za-z\s.]+? )?(millions|billions)"
FRAMEWORK = r"(?i)(IFRS|GAAP)"
PERIOD = r"(?i)year ended ([A-Za-z]+ \d{1,2}, \d{4})"

HEADING_TERMS = ["class actions", "class action", "order execution only", "fees class actions", "legal proceedings", "litigation"]
NAME = r"[A-Z][\w&.'-]+(?:\s+[A-Z][\w&.'-]+){0,4}"
CASE_NAME = rf"(?i)\b({NAME})\s+v(?:\.|s\.|s)?\s+({NAME})\b"
MATTER = rf"(?i)\b({NAME})\s+(matter|class action|litigation|legal proceedings)\b"
# What every match of the two patterns above holds: a cheap test before them.
CASE_MARK, MATTER_WORDS = r"(?i)\sv(?:\.|s\.|s)?\s", r"(?i)\s(?:matter|class action|litigation|legal proceedings)\b"
CLOSED_WORDS = r"(?i)\b(closed|settled|discontinued)\b"
MIN_ITEMS, PASS_RATIO = 3, 0.7
NUMERIC_SPAN = r"(nil|none|zero)?\s*(?:to|through|between|from|-)\s*(?:approximately\s+|approx\.\s+)?\$?\s*[\d,.]+(?:\s*(?:billion|million))?"
