"""Word lists, synonym tables and patterns that results depend on."""

# Values that mean "not given" in sample metadata (fixed values).
MISSING = [
    "", "na", "n/a", "none", "missing", "unknown", "not known", "not collected", "not applicable",
    "not provided", "not available", "-", "null", "unspecified", "other", "restricted access",
]
MISSING_PREFIXES = ["not available", "not applicable", "not collected", "missing"]

# Host names and the common name they are shown as (fixed values).
HOSTS = {
    "homo sapiens": "human", "human": "human", "bos taurus": "cattle", "cattle": "cattle", "cow": "cattle",
    "bovine": "cattle", "sus scrofa": "pig", "sus scrofa domesticus": "pig", "swine": "pig", "porcine": "pig",
    "pig": "pig", "gallus gallus": "chicken", "gallus gallus domesticus": "chicken", "chicken": "chicken",
    "broiler": "chicken", "ovis aries": "sheep", "sheep": "sheep", "capra hircus": "goat", "goat": "goat",
    "canis lupus familiaris": "dog", "canis familiaris": "dog", "dog": "dog", "felis catus": "cat", "cat": "cat",
    "equus caballus": "horse", "horse": "horse", "mus musculus": "mouse", "mouse": "mouse",
    "anas platyrhynchos": "duck", "duck": "duck", "meleagris gallopavo": "turkey", "turkey": "turkey",
    "oryctolagus cuniculus": "rabbit", "rabbit": "rabbit",
}

# Assembly levels in order of completeness; anything else ranks last (fixed values).
LEVELS = {"Complete Genome": 0, "Chromosome": 1, "Scaffold": 2, "Contig": 3}
LEVEL_DEFAULT = 3

# Patterns (fixed values).
SEROTYPE = (
    r"\b(O(?:\d+[a-z]*|NT|R|rough)(?:/O?\d+[a-z]*)?(?::(?:H\d+|H-|HNM|NM|H\?))?)(?![\w-])"
)
FLAGELLAR = r"\b(H\d+)\b"
SEQUENCE_TYPE = r"\bST ?(\d+)\b"
YEAR = r"\b(19\d\d|20\d\d)\b"
GENERIC_PRODUCT = (
    r"(?i)^(hypothetical protein|.*domain-containing protein|DUF\d+.*|.*family protein|putative protein|protein)$"
)
MOBILE_PRODUCT = (
    r"(?i)transpos|integrase|recombinase|phage|prophage|insertion|IS\d|terminase|capsid|portal|tail|excisionase|resolvase"
)

# Functional classes; the first pattern found in the lower-case text names the class (fixed values).
FUNCTION_CLASSES = [
    ("LPS, O-antigen, capsule",
     r"\b(waa|rfa|rfb|wb[a-z]|wz[a-z]|wca|kps|neu)|lipopolysaccharide|o-antigen|capsul|polysaccharide|glycosyltransferase|glycosyl transferase"),
    ("prophage",
     r"phage|integrase|excisionase|terminase|capsid|portal|tail|holin|lysozyme|endolysin|\bcro\b|repressor ci"),
    ("IS, transposase", r"transposase|\bins[a-z]\b|insertion element|\bis[0-9]"),
    ("toxin-antitoxin, defence",
     r"toxin|antitoxin|\bcbt|\bcbe|restriction|methyltransferase|crispr|abortive|\bhig[ab]|\brel[be]\b"),
    ("secretion, adhesion, motility",
     r"secretion|\besc[a-z]|\bsct|\bces|fimbri|\bfim[a-z]|pilus|pilin|\bpap|adhesin|autotransporter|agn43|flagell|\bfli[a-z]|\bflg"),
    ("transport", r"transport|permease|porin|abc |efflux|symporter|antiporter"),
]

# Standard genetic code shared by tables 1 and 11, codons in TCAG order (fixed values).
CODE_BASES = "TCAG"
CODE_AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

# Wordings a reading may not use (fixed values).
NEGATION = r"(?i)\b(lacks?|lacking|absent|missing|do(?:es)? not carry|carry none)\b"
SUPERLATIVE = (
    r"(?i)\b(?:(?:most|least) (?:variable|certain|uncertain|sure|unsure|confident|predictable|unpredictable|stable|"
    r"conserved|reliable|difficult|hard|easy|surprising|open)|surest|hardest|easiest)\b"
)
VAGUE_NUMBER = (
    r"(?i)\b(hundreds?|thousands?|dozens?|half|halves|quarters?|twice|thrice|tenths?|(?:a|one|two)\s+thirds?|"
    r"(?:nine|eight|seven|six|five|four|three|two|one) (?:in|out of) (?:ten|five|four|three|two))\b"
)
EASE = (
    r"(?i)\breadily\b|\bwith ease\b|\beasily\b|\bwithout (?:trouble|difficulty|hesitation)\b|\bhas no trouble\b"
)
ONLY_SHARE = r"(?i)\bonly (?:in |about |around )?(\d+(?:\.\d+)?)\s?%"

# Endings cut from product words, and words that say nothing about a product (fixed values).
ENDINGS = (
    "ases", "ase", "ysis", "oses", "osis", "ations", "ation", "isation", "ization", "ising", "izing", "ing",
    "ers", "er", "ors", "or", "ions", "ion", "ive", "ic", "al", "ed", "es", "s",
)
PLAIN_WORDS = ("with", "from", "that")
