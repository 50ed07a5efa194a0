"""Labels, categories, patterns and word lists that results depend on.

Patterns are in Python's dialect, in the order in which they apply; redactica.functions.regex gives their Java form.
"""

from __future__ import annotations

# --- fixed values: labels ---------------------------------------------------------------------------------------------------
LABELS = ("PESEL", "EMAIL", "TELEFON", "DATA", "PERSON_NAME_TYPO", "ULICA", "MIEJSCOWOSC", "POSTAL_CODE", "NIP", "REGON", "NAZWA_FIRMY", "DOWOD_OSOBISTY", "IBAN")
NER_LABELS = ("NER_PERSON", "NER_ORG", "NER_LOCATION", "NER_MISC")
CATEGORIES = {
    "pesel": ("PESEL",),
    "person": ("NER_PERSON",),
    "phone": ("TELEFON",),
    "email": ("EMAIL",),
    "iban": ("IBAN",),
    "address": ("ULICA", "MIEJSCOWOSC", "POSTAL_CODE", "NER_LOCATION"),
    "company": ("NIP", "REGON", "NAZWA_FIRMY", "NER_ORG"),
    "date": ("DATA",),
}
AUDIT_LABELS = ("EMAIL", "PESEL", "TELEFON", "DATA", "SENSITIVE_DICTIONARY_TERM", "PERSON_NAME_TYPO", "CASE_REFERENCE", "POSTAL_CODE", "ADDRESS_LIKE", "STREET_LIKE", "INITIAL_SURNAME", "ID_LIKE_NUMBER", "LONG_NUMBER_SEQUENCE")
HIGH_RISK_LABELS = ("EMAIL", "PESEL", "TELEFON", "SENSITIVE_DICTIONARY_TERM", "PERSON_NAME_TYPO", "ADDRESS_LIKE", "ID_LIKE_NUMBER", "LONG_NUMBER_SEQUENCE")
AUDIT_ONLY_ADDRESS_LABELS = ("ADDRESS_LIKE", "STREET_LIKE")
HIGH_RISK_TOTAL = 3
RISK_LEVELS = ("ok", "warning", "high_risk")
REVIEW_STATUSES = ("approved", "needs_review", "rejected")
VISUAL_NER_LABELS = ("NER_PERSON", "NER_ORG", "NER_LOCATION")
NER_SCOPES = {"safe": ("NER_PERSON",), "strict": NER_LABELS, "visual": VISUAL_NER_LABELS}
PAGE_SEPARATOR = "\n\f\n"
MAX_PAGE = 20_000
TABLE_LINES_AHEAD = 4
PHONE_CONTEXT_CHARS = 32
LEGAL_ACT_CHARS, PERSONAL_DATE_CHARS, HISTORICAL_YEARS = 150, 60, 100
PLACE_MIN_STEM, PLACE_MAX_INFLECTION = 4, 3
TITLE_CONTEXT_CHARS = 24

# --- fixed values: parts of patterns ----------------------------------------------------------------------------------------
UPPER = "A-ZĄĆĘŁŃÓŚŹŻ"
LETTER = "A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż"
GAP = r"[^\S\n]"
NAME = rf"[{UPPER}][{LETTER}]{{2,}}"
HYPHENS = "-\u00ad\u2010\u2011\u2012\u2013\u2014"
HYPHEN = f"[{HYPHENS}]"
SURNAME = rf"[{UPPER}][{LETTER}]{{2,}}(?:ski|ska|cki|cka|dzki|dzka|ak|ek|ik|yk|uk|cz|icz|wicz|owicz|ewicz)"
HOUSE = rf"\d+[A-Za-z]?(?:/\d+)?(?:{GAP}+(?i:m\.|lok\.){GAP}*\d+[A-Za-z]?)?"
COMPANY_WORD = rf"[{UPPER}\d][{LETTER}\d-]*"
LEGAL_FORM = rf"(?i:sp\.{GAP}*z\.?{GAP}*[o0]\.{GAP}*[o0]\.|s\.a\.|sp\.{GAP}*[kj]\.|s\.k\.a\.|p\.s\.a\.)"
DAY, MONTH = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])"
MONTHS = r"(?:stycznia|lutego|marca|kwietnia|maja|czerwca|lipca|sierpnia|wrze[śs]nia|pa[źz]dziernika|listopada|grudnia)"
PHONE = r"(?:(?:\+48|0048)[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{3}|\d{9})"
STREET_LINE = rf"(?i:ul\.|al\.|ulic[ayę]|aleja|alei|aleję){GAP}*\n{GAP}*"
STREET = rf"(?i:ul\.?|al\.?|pl\.?|ulic[ayę]|aleja|alei|aleję|plac(?:u)?){GAP}+"
NAMES = rf"{NAME}(?:{GAP}+{NAME}){{0,2}}"
STREET_HEAD = r"(?:ul\.|al\.|pl\.|ulica|aleja|plac)\s+[A-Z][A-Za-z-]+(?:\s+[A-Z][A-Za-z-]+){0,2}"
NO_NAME_BEFORE, NO_NAME_AFTER = rf"(?<![\w{HYPHENS[1:]}-])", rf"(?![\w{HYPHENS[1:]}-])"

# --- fixed values: detectors (pattern, ignores case), in order ----------------------------------------------------------------
PERSON_NAME_TYPO = rf"{NO_NAME_BEFORE}{NAME}{GAP}*{HYPHEN}{GAP}*(?:{SURNAME}{GAP}+{NAME}|{NAME}{GAP}+{SURNAME}){NO_NAME_AFTER}"
DETECTORS: dict[str, tuple[str, bool]] = {
    # the wrapped domain is written so that no group repeats without bound; Java's matcher would recurse
    "EMAIL": (r"(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+(?:(?<=-)\n[A-Za-z0-9.-]*)*\.[A-Za-z]{2,}(?!\w)", False),
    "PESEL": (r"(?<!\w)\d{11}(?!\w)", False),
    "DOWOD_OSOBISTY": (r"(?<!\w)[A-Z]{3}\d{6}(?!\w)", False),
    "IBAN": (r"(?<!\w)PL\s?[\dO]{2}(?:\s?[\dO]{4}){6}(?!\w)", True),
    "NIP": (rf"(?<!\w)NIP{GAP}*[:.-]?{GAP}*\d(?:[\s-]?\d){{9}}(?!\w)", True),
    "REGON": (rf"(?<!\w)REGON{GAP}*[:.-]?{GAP}*(?:\d(?:[\s-]?\d){{13}}|\d(?:[\s-]?\d){{8}})(?!\w)", True),
    "NAZWA_FIRMY": (rf"(?<!\w){COMPANY_WORD}(?:{GAP}+(?:[i&]{GAP}+)?{COMPANY_WORD}){{0,5}}{GAP}+{LEGAL_FORM}(?!\w)", False),
    "TELEFON": (rf"(?<![\w+]){PHONE}(?!\w)", False),
    "DATA": (rf"(?<!\w)(?:\d{{4}}-{MONTH}-{DAY}|{DAY}\.{MONTH}\.\d{{4}}|{DAY}-{MONTH}-\d{{4}}|{DAY}/{MONTH}/\d{{4}}|(?:0?[1-9]|[12]\d|3[01]){GAP}+{MONTHS}{GAP}+\d{{4}})(?!\w)", True),
    "ULICA": (rf"(?<!\w)(?:(?:{STREET_LINE}|{STREET}){NAMES}(?:{GAP}+{HOUSE})?|(?i:adres:?){GAP}+{NAMES}{GAP}+{HOUSE})(?!\w)", False),
    "MIEJSCOWOSC": (rf"(?<=\d{{2}}-\d{{3}}{GAP}){NAME}(?:{HYPHEN}{NAME})?(?:{GAP}{NAME})?", False),
    "POSTAL_CODE": (r"(?<!\w)\d{2}-\d{3}(?!\w)", False),
    "PERSON_NAME_TYPO": (PERSON_NAME_TYPO, False),
}
#: What the first character of a detector's match is, of either case where the detector ignores case.
FIRST = {
    "PESEL": r"\d", "DOWOD_OSOBISTY": "[A-Z]", "IBAN": "P", "NIP": "N", "REGON": "R", "NAZWA_FIRMY": rf"[{UPPER}\d]", "TELEFON": r"[+\d]", "DATA": r"\d",
    "ULICA": "[AaPpUu]", "MIEJSCOWOSC": f"[{UPPER}]", "POSTAL_CODE": r"\d", "PERSON_NAME_TYPO": f"[{UPPER}]",
}
#: What a text must hold anywhere for a detector or an audit pattern to match: (pattern, ignores case), cheap to look for.
NEEDED: dict[str, tuple[str, bool]] = {
    "EMAIL": ("@", False), "PESEL": (r"\d{11}", False), "IBAN": (r"PL\s?[\dO]{2}", True), "NIP": ("NIP", True), "REGON": ("REGON", True),
    "NAZWA_FIRMY": (r"(?:sp|s\.a|s\.k\.a)\.", True), "TELEFON": (r"\d{9}|\+48|0048", False), "DATA": (r"\d{4}", False),
    "MIEJSCOWOSC": (r"\d{2}-\d{3}", False), "POSTAL_CODE": (r"\d{2}-\d{3}", False), "PERSON_NAME_TYPO": (rf"{HYPHEN}{GAP}*[{UPPER}]", False),
    "LONG_NUMBER_SEQUENCE": (r"\d(?:[ -]?\d){11}", False), "CASE_REFERENCE": (r"/\s*\d|[A-Z]\.\d|(?:REF|CASE|SPRAWA)[- ]\d", False),
}
WEAK_PHONE = r"(?<![\w+])(?<!\d\.)\d{3}[-\s.]\d{3}[-\s.]\d{3}(?!\.\d)(?!\w)"
PHONE_CONTEXT = r"(?:tel\.?|telefon|kom\.?|mobile|fax|kontakt|numer telefonu|phone|pod\s+numerem|z\s+numeru|komórk\w*)\s*[:\-]?\s*$"
BARE_LABEL = {"NIP": r"(?<!\w)NIP(?!\w)", "REGON": r"(?<!\w)REGON(?!\w)"}
BARE_VALUE = {"NIP": r"(?<!\w)\d(?:[\s-]?\d){9}(?!\w)", "REGON": r"(?<!\w)(?:\d(?:[\s-]?\d){13}|\d(?:[\s-]?\d){8})(?!\w)"}
ORGANISATION_KIND = r"(?i:wspóln\w*|spółdziel\w*|nzoz|spzoz|przychodni\w*|poradni\w*|laborator\w*|stowarzysz\w*|fundacj\w*|hotel\w*|pensjonat\w*|restaurac\w*|kawiarni\w*|sklep\w*|firm[aąęy]|zakład\w*|ośrod\w*|klub\w*|aptek\w*|gabinet\w*|szkoł\w*|szkol\w*|przedszkol\w*)"
#: What a quoted name begins with.
QUOTES = ("„", ",,", '"', "“")
QUOTED = r"(?:„|,,|\"|“)[^„”\"“\n]{2,60}(?:”|\"|“)"
QUOTED_ORGANISATION = rf"(?<!\w){ORGANISATION_KIND}(?:{GAP}+[{UPPER}][{LETTER}-]*){{0,2}}(?:{GAP}+|{GAP}*\n{GAP}*){QUOTED}"
PATRON_WORD = rf"[{UPPER}][{LETTER}.-]*"
PATRON_FACILITY = rf"(?<!\w)[{UPPER}][{LETTER}-]+(?:{GAP}+(?:[{UPPER}][{LETTER}-]+|nr{GAP}*\d+)){{0,3}}{GAP}+im\.{GAP}+(?:(?i:gen|św|ks|dr|prof|kard|bł)\.{GAP}+)?{PATRON_WORD}(?:{GAP}+{PATRON_WORD}){{0,2}}"
LEGAL_ACT = r"(?<!\w)(?:ustaw\w*|rozporządz\w*|dyrektyw\w*|kodeks\w*|obwieszcz\w*|konwencj\w*|traktat\w*)"
Z_DNIA = r"(?<!\w)z\s+dnia\s*$"
SENTENCE_BREAK = rf"[.!?;]\s+[{UPPER}]"
PERSONAL_DATE = r"(?:(?<!\w)ur\.|urodz\w*|(?<!\w)zm\.|zmar\w*|zgon\w*|śmier\w*|(?<!\w)data(?!\w))"
PLACE_ENDINGS = ("iec", "ec", "ie", "e", "y", "i", "a", "o")
PLACE_ENDING = f"(?:{'|'.join(PLACE_ENDINGS)})$"
PLACE_GAP = rf"(?:{GAP}+|{GAP}*\n{GAP}*)"
PLACE_ADJECTIVE = rf"[{UPPER}][{LETTER}]*(?:y|i|a|e|ym|im|ej|ego|iego|emu|ą|ie)"

# --- fixed values: audit patterns ---------------------------------------------------------------------------------------------
AUDIT: dict[str, str] = {
    "EMAIL": r"(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?!\w)",
    "PESEL": r"(?<!\w)\d{11}(?!\w)",
    "TELEFON": rf"(?<![\w+]){PHONE}(?!\w)",
    "DATA": rf"(?<!\w)(?:\d{{4}}-{MONTH}-{DAY}|{DAY}\.{MONTH}\.\d{{4}})(?!\w)",
    "PERSON_NAME_TYPO": PERSON_NAME_TYPO,
    "CASE_REFERENCE": r"(?<!\w)(?:[A-Z]{1,4}\s*/\s*\d{1,6}\s*/\s*(?:\d{2}|\d{4})|[A-Z]{1,4}\.\d{1,6}\.\d{2,4}|(?:REF|CASE|SPRAWA)[- ]\d{2,4}[-/]\d{1,6})(?!\w)",
    "POSTAL_CODE": r"(?<!\w)\d{2}-\d{3}(?!\w)",
    "ADDRESS_LIKE": rf"(?<!\w){STREET_HEAD}\s+\d+[A-Za-z]?(?:/\d+)?(?!\w)",
    "STREET_LIKE": rf"(?<!\w){STREET_HEAD}(?!\s+\d)(?!\w)",
    "INITIAL_SURNAME": r"(?<!\w)[A-Z]\.\s+[A-Z][A-Za-z-]{2,}(?!\w)",
    "ID_LIKE_NUMBER": r"(?<!\w)(?:ID|IDENTYFIKATOR|NR|NIP|REGON|KRS|PASZPORT|DOWOD)[:\s.-]*\d{4,12}(?!\w)",
    # runs of any length; those with fewer than 12 digits are dropped after the match
    "LONG_NUMBER_SEQUENCE": r"(?<!\w)\d++(?:[ -]\d++)*(?!\w)",
}
LONG_NUMBER_DIGITS = 12

# --- fixed values: placeholders, file names, sentences ------------------------------------------------------------------------
NER_PLACEHOLDER = r"\[[A-Z0-9_ ]+\]"
PLACEHOLDER = r"\[[^\[\]\r\n]{1,80}\]"
FILE_NAME_PII = {
    "PESEL": r"(?<!\d)\d{11}(?!\d)",
    "NIP": r"(?<!\d)\d{10}(?!\d)",
    "REGON": r"(?<!\d)(?:\d{9}|\d{14})(?!\d)",
    "dowód osobisty": r"(?<![A-Za-z0-9])[A-Z]{3}\d{6}(?![A-Za-z0-9])",
    "e-mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "numer telefonu": r"(?<!\d)(?:\+?48[\s._-]?)?\d{3}[\s._-]?\d{3}[\s._-]?\d{3}(?!\d)",
}
OUTPUT_FAMILIES = {
    "batch_summary": r"^_BATCH_SUMMARY(_\d+)?\.txt$",
    "batch_checklist": r"^_BATCH_REVIEW_CHECKLIST(_\d+)?\.txt$",
    "anon_txt": r"^(.+)_ANON(_\d+)?\.txt$",
    "anon_docx": r"^(.+)_ANON(_\d+)?\.docx$",
    "visual": r"^(.+)_ANON_VISUAL(_\d+)?\.pdf$",
    "review": r"^(.+)_ANON_REVIEW(_\d+)?\.pdf$",
    "original_redacted": r"^(.+)_ORIGINAL_REDACTED(_\d+)?\.pdf$",
    "report": r"^(.+)_RAPORT(_\d+)?\.txt$",
    "checklist": r"^(.+)_REVIEW_CHECKLIST(_\d+)?\.txt$",
    "manual_edits": r"^(.+)_MANUAL_EDITS(_\d+)?\.json$",
}
#: What a box drawn by hand, or taken over from a suggestion, is called; the first is the plain one.
MANUAL_LABELS = ("RECZNE", "AI_SUGESTIA")
FINAL_FAMILIES = ("anon_txt", "anon_docx", "visual", "review", "original_redacted", "manual_edits")
ABBREVIATIONS = ("np.", "itp.", "itd.", "tzw.", "m.in.", "tj.", "ul.", "al.", "pl.", "godz.", "tel.", "dr.", "mgr.", "prof.", "inż.", "nr.", "zł.", "pkt.", "art.", "ust.", "poz.", "wg.", "ok.", "r.", "w.", "os.")
SENTENCE_START = rf"[{UPPER}0-9\"„“(]"
MAX_REVIEW_CHARS, MAX_REVIEW_SENTENCES, MAX_SENTENCE_CHARS = 20_000, 400, 500
SAFE_PADDING = ".,;:!?()[]{}<>\"'„”“‚‘’«»‹›…"
MIN_OCR_CONFIDENCE = 40
COVERED_GLYPH_SHARE = 0.25
POINT_TOLERANCE, GLYPH_TOLERANCE = 0.5, 1.0

# --- fixed values: named entities ---------------------------------------------------------------------------------------------
MODEL_LABELS = {
    "PER": "NER_PERSON", "PERSON": "NER_PERSON", "PERSNAME": "NER_PERSON", "PERS_NAME": "NER_PERSON",
    "ORG": "NER_ORG", "ORGNAME": "NER_ORG", "ORG_NAME": "NER_ORG",
    "LOC": "NER_LOCATION", "GPE": "NER_LOCATION", "PLACE": "NER_LOCATION", "PLACENAME": "NER_LOCATION", "PLACE_NAME": "NER_LOCATION",
    "MISC": "NER_MISC",
}
VERSION_LIKE = r"\b(?:version|wersja)\s+\d+(?:\.\d+)+(?:\s*,\s*\d{4})?\b"
DASHES = "\u00ad\u2010\u2011\u2012\u2013\u2014\u2212"
PUBLIC_INSTITUTIONS = (
    "ecdc", "gus", "minister zdrowia", "ministerstwo zdrowia", "ministra zdrowia", "państwowa inspekcja sanitarna", "państwową inspekcją sanitarną",
    "państwową inspekcję sanitarną", "państwowej inspekcji sanitarnej", "państwowy powiatowy inspektor sanitarny", "państwowego powiatowego inspektora sanitarnego",
    "powiatowej stacji", "powiatowa stacja sanitarno-epidemiologiczna", "powiatowej stacji sanitarno-epidemiologicznej", "rozporządzenie ministra zdrowia",
    "rozporządzenia ministra zdrowia", "stanu sanitarnego powiatu", "światowa organizacja zdrowia", "światową organizację zdrowia", "urząd statystyczny",
    "urzędem statystycznym", "urzędem statystycznym w krakowie", "ojewódzkiej stacji sanitarno-epidemiologicznej",
    "wojewódzka stacja sanitarno-epidemiologiczna", "wojewódzkiej stacji sanitarno-epidemiologicznej", "who",
)
SCIENTIFIC_NAMES = (
    "streptococcus pneumoniae", "neisseria meningitidis", "salmonella enteritidis", "escherichia coli", "pseudomonas aeruginosa", "haemophilus influenzae",
    "błonica", "błonica-tężec-krztusiec", "clostridium perfringens", "e. coli", "enterica", "enteritidis", "gruźlica", "haemophilus", "krztusiec", "neisseria",
    "odra", "ospa", "polio", "płonica", "róża", "różyczka", "salmonella", "salmonella enterica", "salmoneloza", "salmonelozę", "streptococcus", "tężec",
    "tężec-błonica", "wzw b", "zakażenia neisseria", "świnka",
)
ORDINARY_WORDS = ("epidemiologicznej", "publicznej", "wiotkie", "żywnością", "pesel", "nip", "regon")
PERSON_TITLE = r"(?:^|[\s(])(?:mgr(?:\s+inż\.?|\s+inz\.?)?|dr|lek\.?|prof\.?|pan|pani)\.?\s*$"
LATIN_BINOMIAL = r"^[A-Z][A-Za-z-]+\s+[a-z][a-z-]+$"

# --- fixed values: language model review ----------------------------------------------------------------------------------------
FINDING_TYPES = ("missed_redaction", "unnecessary_redaction")
RESIDUAL_CATEGORIES = ("PERSON_LIKE", "ORGANIZATION_LIKE", "LOCATION_LIKE", "ADDRESS_CONTEXT", "CASE_REFERENCE_LIKE", "CONTACT_DATA_LIKE", "OTHER_SENSITIVE_CONTEXT")
CONFIDENCES = ("certain", "likely", "uncertain")
NARRATIVE_CATEGORIES = ("QUASI_IDENTIFIER_COMBINATION",)

# --- fixed values: answer-key policy, checksum weights, retrieval ---------------------------------------------------------------
POLICY = {
    "pesel": "must", "nip": "must", "regon": "must", "iban": "must", "id_card": "must", "phone": "must", "email": "must", "person_private": "must",
    "deceased_private": "must", "nickname": "must", "address": "must", "postal_code": "must", "place_name": "must", "facility_name": "must",
    "company_name": "must", "birth_date": "must", "case_reference": "must", "licence_number": "optional", "drug_name": "optional", "ean": "optional",
    "document_date": "optional", "document_number": "optional", "quasi_identifier": "optional", "institution_public": "optional",
    "public_figure": "keep", "historical_date": "keep", "statute_reference": "keep",
}
POLICY_ONLY_WITH = {"case_reference": "sygnatury"}
PESEL_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
NIP_WEIGHTS = (6, 5, 7, 2, 3, 4, 5, 6, 7)
REGON_WEIGHTS = (8, 9, 2, 3, 4, 5, 6, 7)
CHUNK_CHARS, CHUNK_OVERLAP, MIN_TOKEN = 1200, 120, 2
