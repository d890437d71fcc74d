"""Values that must equal the reference's for equal results."""

# File extensions that are indexed by default.
EXTENSIONS = (
    ".ts", ".tsx", ".js", ".jsx", ".py", ".java", ".cpp", ".c", ".h", ".hpp",
    ".cs", ".go", ".rs", ".php", ".rb", ".swift", ".kt", ".scala", ".m", ".mm",
    ".md", ".markdown", ".ipynb",
)

# Default ignore patterns.
IGNORE_PATTERNS = (
    "node_modules/**", "dist/**", "build/**", "out/**", "target/**", "coverage/**", ".nyc_output/**",
    ".vscode/**", ".idea/**", "*.swp", "*.swo",
    ".git/**", ".svn/**", ".hg/**",
    ".cache/**", "__pycache__/**", ".pytest_cache/**",
    "logs/**", "tmp/**", "temp/**", "*.log",
    ".env", ".env.*", "*.local",
    "*.min.js", "*.min.css", "*.min.map", "*.bundle.js", "*.bundle.css", "*.chunk.js", "*.vendor.js", "*.polyfills.js", "*.runtime.js", "*.map",
    "node_modules", ".git", ".svn", ".hg", "build", "dist", "out", "target", ".vscode", ".idea", "__pycache__", ".pytest_cache", "coverage", ".nyc_output", "logs", "tmp", "temp",
)

# Language by extension; anything else is "text".
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".java": "java", ".cpp": "cpp",
    ".c": "c", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust", ".php": "php", ".rb": "ruby", ".swift": "swift",
    ".kt": "kotlin", ".scala": "scala", ".m": "objective-c", ".mm": "objective-c", ".ipynb": "jupyter",
}
OTHER_LANGUAGE = "text"

# Languages that are split by syntax, and other names for them.
SYNTAX_LANGUAGES = ("javascript", "typescript", "python", "java", "cpp", "go", "rust", "csharp", "scala")
SYNTAX_ALIASES = {"js": "javascript", "ts": "typescript", "py": "python", "c++": "cpp", "c": "cpp", "rs": "rust", "cs": "csharp"}

# Languages with separators of their own in the character splitter, and other names for them.
SEPARATOR_LANGUAGES = ("js", "python", "java", "cpp", "go", "rust", "php", "ruby", "swift", "scala", "html", "markdown", "latex", "sol")
SEPARATOR_ALIASES = {"javascript": "js", "typescript": "js", "c++": "cpp", "c": "cpp", "md": "markdown", "tex": "latex", "solidity": "sol"}

# Sizes and limits.
SYNTAX_CHUNK, SYNTAX_OVERLAP = 2500, 300
CHAR_CHUNK, CHAR_OVERLAP = 1000, 200
LINE_CHUNK, LINE_OVERLAP, LINE_LEAST = 1000, 200, 10
EMBED_BATCH, CHUNK_CAP = 100, 450_000
RRF_K, BM25_K1, BM25_B = 100, 1.2, 0.75
DENSE_LIMIT, TOOL_LIMIT, TOOL_MOST, QUERY_CAP = 10, 10, 50, 16_384
LARGE_FILE_CHUNKS, LARGE_FILE_CHARS = 50, 100_000

# Extensions taken from a remote repository's tree.
REMOTE_EXTENSIONS = r"\.(ts|tsx|js|jsx|py|java|cpp|c|h|hpp|cs|go|rs|php|rb|swift|kt|scala|m|mm|md)$"

# Names left out of directory listings, and hidden names that stay.
LISTING_SKIPS = ("node_modules", "__pycache__", ".git", ".svn", ".hg", "venv", "env")
LISTING_HIDDEN_KEPT = (".env", ".gitignore", ".gitattributes")
TEST_WORDS = ("test", "tests", "testing")

# Patterns for files named by edit results, edit calls and patches.
EDIT_RESULT = r"Successfully modified file:\s*(.+?)(?:\s|$)"
EDIT_CALL = r"(?i)edit.*?file_path[\"']?\s*:\s*[\"']([^\"']+)[\"']"
PATCH_OLD_FILE = "--- a/(.+)"
PATCH_HEADER = r"(?m)^diff --git a/(.*?) b/(.*?)$"
