"""Lists, tables and constants that results must agree on."""

# --- fixed values: file discovery ---------------------------------------------------------
SUPPORTED_EXTENSIONS = [
    ".ts", ".tsx", ".js", ".jsx", ".py", ".java", ".cpp", ".c", ".h", ".hpp",
    ".cs", ".go", ".rs", ".php", ".rb", ".swift", ".kt", ".scala", ".m", ".mm",
    ".md", ".markdown", ".ipynb",
]

DEFAULT_IGNORE_RULES = [
    "node_modules/**", "dist/**", "build/**", "out/**", "target/**", "coverage/**", ".nyc_output/**",
    ".vscode/**", ".idea/**", "*.swp", "*.swo",
    ".git/**", ".svn/**", ".hg/**",
    ".cache/**", "__pycache__/**", ".pytest_cache/**",
    "logs/**", "tmp/**", "temp/**", "*.log",
    ".env", ".env.*", "*.local",
    "*.min.js", "*.min.css", "*.min.map", "*.bundle.js", "*.bundle.css", "*.chunk.js",
    "*.vendor.js", "*.polyfills.js", "*.runtime.js", "*.map",
    "node_modules", ".git", ".svn", ".hg", "build", "dist", "out", "target", ".vscode", ".idea",
    "__pycache__", ".pytest_cache", "coverage", ".nyc_output", "logs", "tmp", "temp",
]

# --- fixed values: languages (id, extensions, splitter flag, symbol-and-graph flag) --------
# The symbol flag covers symbol metadata, graph build, graph query and file outline alike.
LANGUAGES = [
    ("typescript", [".ts", ".tsx"], True, True),
    ("javascript", [".js", ".jsx", ".mjs", ".cjs"], True, True),
    ("python", [".py"], True, True),
    ("java", [".java"], True, False),
    ("cpp", [".cpp", ".c", ".h", ".hpp"], True, False),
    ("go", [".go"], True, False),
    ("rust", [".rs"], True, False),
    ("csharp", [".cs"], True, False),
    ("scala", [".scala"], True, False),
    ("php", [".php"], False, False),
    ("ruby", [".rb"], False, False),
    ("swift", [".swift"], False, False),
    ("kotlin", [".kt"], False, False),
    ("objective-c", [".m", ".mm"], False, False),
    ("jupyter", [".ipynb"], False, False),
    ("text", [".md", ".markdown"], False, False),
]

# --- fixed values: other names of languages ---
LANGUAGE_ALIASES = {
    "ts": "typescript", "js": "javascript", "py": "python", "c++": "cpp", "c": "cpp", "rs": "rust", "cs": "csharp",
    "rb": "ruby", "kt": "kotlin", "objectivec": "objective-c", "ipynb": "jupyter", "md": "text", "markdown": "text",
}

# --- fixed values: path categories ---------------------------------------------------------
DOC_SEGMENTS = ["docs", "doc", "documentation", "guide", "guides"]
DOC_SUFFIXES = [".md", ".mdx", ".rst", ".adoc", ".txt"]
TEST_SEGMENTS = ["test", "tests", "__tests__"]
GENERATED_INFIXES = ["/dist/", "/build/", "/coverage/", "/.next/", "/generated/"]
GENERATED_SUFFIXES = [".min.js", ".min.css"]
GENERATED_NOISE_SEGMENTS = ["coverage", "dist", "build"]
FIXTURE_SEGMENTS = ["fixtures", "__fixtures__"]
ENTRY_PREFIXES = ["main.", "index.", "app.", "server.", "cli.", "entry."]

# --- fixed values: score multiplier by scope and path category -----------------------------
SCOPE_MULTIPLIERS = {
    "runtime": {"entrypoint": 1.40, "core": 1.25, "srcRuntime": 1.10, "neutral": 1.00,
                "tests": 0.65, "docs": 0.55, "generated": 0.40},
    "mixed": {"entrypoint": 1.15, "core": 1.10, "srcRuntime": 1.05, "neutral": 1.00,
              "tests": 0.90, "docs": 0.90, "generated": 0.70},
    "docs": {"entrypoint": 0.50, "core": 0.50, "srcRuntime": 0.50, "neutral": 0.80,
             "tests": 1.10, "docs": 1.20, "generated": 0.40},
}

# --- fixed values: search ------------------------------------------------------------------
STORE_RRF_K = 100          # dense + sparse lists
PASS_RRF_K = 60            # primary + expanded passes
RERANK_RRF_K = 10
RERANK_TOP = 50
RERANK_MAX_LINES = 200
RERANK_MAX_CHARS = 4000
PREVIEW_CHARS = 4000
MAX_CANDIDATES = 80
MIN_CANDIDATES = 32
CANDIDATES_PER_RESULT = 8
MUST_RETRIES = 2
LINE_BUCKET = 25
OPERATOR_WINDOW = 200
MAX_LEXICAL_TERMS = 8
FILE_CAP = 2
RELAXED_FILE_CAP = 3
CHANGED_BOOST = 1.10
CHANGED_MAX_FILES = 50
NOISE_TOP = 5
NOISE_SHARE = 0.60
NOISE_PATTERNS = ["**/*.test.*", "**/*.spec.*", "**/__tests__/**", "**/__fixtures__/**",
                  "**/fixtures/**", "coverage/**"]
EXPANSION = "\nimplementation runtime source entrypoint"
FRESH_SECONDS = 30 * 60
AGING_SECONDS = 24 * 60 * 60
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "find", "for", "from", "how", "in", "is",
             "it", "logic", "of", "or", "the", "to", "used", "uses", "using", "what", "where", "which",
             "who", "why"]
# weight of lexical evidence by intent; "mixed_ref" is mixed intent in a reference-seeking query
LEXICAL_WEIGHTS = {"identifier": 1.35, "mixed": 0.05, "mixed_ref": 0.18, "uncertain": 0.60, "semantic": 0.0}
# tier -> (normal, reference-seeking, reference-seeking and declared in the same text)
EVIDENCE_TIERS = {
    "executable": (None, 1.60, None),
    "import": (None, 0.75, None),
    "label_boundary": (1.30, 0.02, 0.02),
    "path_boundary": (1.20, 0.02, 0.02),
    "content_boundary": (0.90, 1.25, 0.10),
    "label_part": (0.55, 0.04, 0.04),
    "path_part": (0.45, 0.04, 0.04),
    "content_part": (0.25, 0.30, 0.08),
}
FRAGMENT_FACTOR = 0.35
FRAGMENT_FACTOR_STRICT = 0.18   # identifier intent or reference-seeking

# --- fixed values: BM25 --------------------------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
TERM_PATTERN = "[a-z0-9_]+"

# --- fixed values: indexing ----------------------------------------------------------------
CHUNK_CAP = 450_000
QUERY_LIMIT = 16_384
EMBED_BATCH = 100
BREADCRUMB_CHARS = 120
BREADCRUMB_DEPTH = 2
CONTROL_FILES = [".gitignore", ".indexignore"]
MARKER_KIND = "index_completion_v1"

# --- fixed values: symbol graph ------------------------------------------------------------
CALL_KEYWORDS = ["if", "for", "while", "switch", "catch", "return", "new", "typeof", "function", "class",
                 "def", "await", "with", "from", "import"]
CONFIDENCE = {"call": (0.92, 0.78), "dynamic": (0.72, 0.62), "import": (0.65, 0.55)}  # same file, other file
TRAVERSE_MAX_DEPTH = 3
TRAVERSE_LIMIT = 20
NOTE_LIMIT = 200
OUTLINE_LIMIT = 500
READ_MAX_LINES = 1000

# --- fixed values: state -------------------------------------------------------------------
RECOVERY_GRACE_SECONDS = 2 * 60
INDEXING_STALE_SECONDS = 10 * 60
DEBOUNCE_SECONDS = 5
SYNC_THRESHOLD_SECONDS = 60
