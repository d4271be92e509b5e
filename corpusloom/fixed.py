"""Lists, tables, patterns and formats that results depend on."""

# --- fixed values: file selection ------------------------------------------------
CODE_EXTENSIONS = [".js", ".ts", ".jsx", ".tsx", ".py", ".java", ".go", ".rs", ".rb", ".php", ".c", ".cpp", ".cs"]
CODE_SKIP_DIRS = ["node_modules", ".git", "dist", "build", "coverage", ".next", "temp_repos"]
CONTEXT_EXTENSIONS = [".js", ".jsx", ".ts", ".tsx", ".py", ".java", ".go", ".rs", ".cpp", ".c", ".h"]
CONTEXT_SKIP_DIRS = ["node_modules", ".git", "dist", "build", ".next", "coverage", "__pycache__"]
MAX_FILE_BYTES = 100000

# --- fixed values: language by extension -----------------------------------------
LANGUAGES = {
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".py": "python",
    ".java": "java",
    ".cpp": "cpp",
    ".c": "c",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
}
JS_EXTENSIONS = [".js", ".jsx", ".mjs"]
TS_EXTENSIONS = [".ts", ".tsx"]
PY_EXTENSIONS = [".py"]

# --- fixed values: extraction patterns -------------------------------------------
PY_IMPORT = r"^(?:from\s+(\S+)\s+)?import\s+(.+)"
PY_FUNCTION = r"^def\s+(\w+)\s*\((.*?)\)"
PY_CLASS = r"^class\s+(\w+)(?:\(.*?\))?:"
GENERIC_FUNCTIONS = [
    r"function\s+(\w+)\s*\(",
    r"def\s+(\w+)\s*\(",
    r"(\w+)\s*[:=]\s*function\s*\(",
    r"(\w+)\s*[:=]\s*\([^)]*\)\s*=>",
    r"const\s+(\w+)\s*=\s*\([^)]*\)\s*=>",
]
GENERIC_CLASSES = [r"class\s+(\w+)", r"interface\s+(\w+)", r"type\s+(\w+)\s*="]
EXPORT_ANYWHERE = r"export\s+(?:const|let|var|class|function|interface|type)\s+(\w+)"
IMPORT_CLAUSE = r"import\s+(?:\{([^}]+)\}|\*\s+as\s+(\w+)|(\w+))\s+from\s+['\"](.*?)['\"]"

# --- fixed values: lint and repair -----------------------------------------------
LINT_STATEMENT = r"^(import|export|return|const|let|var)\s+"
REPAIR_STATEMENT = r"^(import|export|return|throw|break|continue|type|interface)\s+"
REPAIR_ASSIGNMENT = r"^(const|let|var)\s+\w+\s*=\s*.+[^=,]$"
INCOMPLETE_OBJECT = r"export\s+(const|let|var)\s+(\w+)\s*=\s*\n\s*async\s+(\w+)"
COMMA_BEFORE_METHOD = r"\}\s*,?\s*\n\s*async\s+(\w+)"
COMMA_BETWEEN_PROPERTIES = r"(\w+:\s*[^,\n]+)\s*\n\s*(\w+:)"
INCOMPLETE_TYPE = r"(?m):\s*$"
TRAILING_COMMA_AT_END = r"(?m),(\s*\}\s*;?\s*)$"
TRAILING_COMMA = r",(\s*[}\]])"
FIXED_OBJECT = "Fixed incomplete object literal after export declaration"
FIXED_COMMAS = "Added missing commas in object literals"
FIXED_TYPES = 'Added default "any" type for incomplete annotations'

# --- fixed values: naming defects ------------------------------------------------
LOW_SIMILARITY = 0.5
HIGH_SIMILARITY = 0.7
SHORT_NAME = 5
HIGH_REASON = 'Export name "%s" doesn\'t match import "%s" which is closer to file name "%s"'
MEDIUM_REASON = 'Export name "%s" appears to be a typo. File name is "%s" and imported as "%s"'

# --- fixed values: search, context and budgets -----------------------------------
VECTOR_DIM = 384
TOP_K = 10
SIMILAR_K = 5
CONTEXT_SYMBOLS = 50
CONTEXT_FILES = 10
PATTERN_SYMBOLS = 30
PATTERN_FILES = 15
SNIPPET_HITS = 5
SNIPPET_LINES = 5
NAMES_PER_FILE = 10
REFERENCES_PER_SYMBOL = 5
LISTING_LIMIT = 50
SUMMARY_BUDGET = 50000
MEMORY_ENTRIES = 50
RECENT_ENTRIES = 3
DEFAULT_QUERY = "code quality and improvements"
REVIEW_QUERY = (
    "code quality issues, bugs, security vulnerabilities, performance problems, best practices violations"
)
PATTERN_QUERIES = {
    "security": "security vulnerabilities, SQL injection, XSS, authentication issues, password handling",
    "performance": "performance issues, slow loops, inefficient algorithms, memory leaks, N+1 queries",
    "bugs": "potential bugs, null pointer, undefined, error handling, edge cases",
    "best-practices": "code quality, best practices, clean code, SOLID principles, maintainability",
    "dependencies": "external dependencies, imports, third-party libraries, API calls",
    "testing": "test coverage, unit tests, integration tests, test cases, assertions",
}
SUGGESTION_PATTERNS = ["security", "performance", "best-practices", "testing"]
SIMILAR_QUERY_PREFIX = "function or class named "

# --- fixed values: review texts --------------------------------------------------
NO_CHANGE = r"(?i)no (major )?(issues|changes|improvements)"
CLEAN_SUMMARY = "No improvements required. Code looks clean!"
NO_JSON_SUMMARY = "AI gave unexpected response, check raw output"
BAD_JSON_SUMMARY = "Failed to parse AI response"
