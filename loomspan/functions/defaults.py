"""Dimension rows: routing, budgets, keywords, extensions and limits (fixed values of the data model)."""

from __future__ import annotations

# Collections, in order.
COLLECTIONS = ["code_symbols", "code_routes", "code_usage", "configs", "docs", "security_tags", "flows"]

# Node types by collection; other types are not indexed.
ROUTING = {
    "code_symbols": ["function", "class", "component", "table", "view", "query", "notebook_code"],
    "code_routes": ["route", "entrypoint"],
    "code_usage": ["call_edge", "import_usage"],
    "docs": ["doc", "comment", "comment_line", "comment_block", "comment_doc", "comment_other", "doc_code"],
    "security_tags": ["auth_guard", "policy_check", "audit_log", "sensitive_op"],
    "flows": ["flow_chain"],
    "configs": ["config"],
}

# Retrieval weight by intent and collection (in the order of COLLECTIONS).
INTENT_WEIGHTS = {
    "audit": [1.0, 3.0, 3.0, 1.0, 1.0, 4.0, 2.0],
    "security": [1.0, 2.0, 3.0, 1.0, 1.0, 4.0, 2.0],
    "config": [1.0, 1.0, 1.0, 5.0, 2.0, 2.0, 1.0],
    "general": [3.0, 2.0, 2.0, 2.0, 3.0, 2.0, 1.0],
    "flow": [1.0, 3.0, 4.0, 1.0, 1.0, 2.0, 5.0],
}

# Keywords by intent; ties go to the earlier intent.
INTENT_KEYWORDS = {
    "audit": ["audit", "compliance", "trace", "evidence", "control"],
    "security": ["auth", "authorization", "policy", "rbac", "abac", "permission", "jwt", "oauth"],
    "config": ["config", "yaml", "json", "env", "feature flag", "scope", "provider"],
    "flow": ["flow", "call chain", "execution path", "path", "trace route"],
}

# Language by file extension.
LANGUAGE_OF_EXT = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".kt": "kotlin",
    ".kts": "kotlin", ".scala": "scala", ".sc": "scala", ".cs": "csharp", ".cob": "cobol", ".cbl": "cobol", ".cpy": "cobol", ".r": "r",
    ".sql": "sql", ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".h": "cpp", ".hh": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".go": "go",
    ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".toml": "toml", ".ini": "ini", ".md": "markdown", ".txt": "text", ".ipynb": "notebook",
}

# Root files that name a stack.
STACK_SIGNALS = {
    "python": ["requirements.txt", "pyproject.toml", "setup.py", "Pipfile"],
    "node": ["package.json", "pnpm-lock.yaml", "yarn.lock", "package-lock.json"],
    "java": ["pom.xml", "build.gradle", "build.gradle.kts"],
    "scala": ["build.sbt", "project/build.properties", "build.sc"],
    "dotnet": [".sln"],
    "go": ["go.mod"],
    "r": ["renv.lock", "DESCRIPTION"],
}
STACK_SUFFIXES = {"dotnet": [".csproj"]}
MANIFESTS = ["requirements.txt", "pyproject.toml", "package.json", "pom.xml", "build.gradle", "Dockerfile"]

# Review candidates.
IMPORTANT_DIRS = ["api/", "src/", "app/", "routes/", "controllers/", "security/", "auth/", "middleware/", "service/", "services/"]
IMPORTANT_WORDS = ["auth", "jwt", "oauth", "permission", "policy", "role", "rbac", "abac", "audit", "transfer", "customer"]
SECURITY_TYPES = ["auth_guard", "policy_check", "audit_log", "sensitive_op"]

# Tokens before "(" that are not calls.
CALL_SKIP = [
    "if", "for", "while", "switch", "catch", "return", "sizeof", "typeof", "new", "throw", "assert", "await", "lambda",
    "super", "this", "base", "class", "def", "function", "defer", "select", "go",
]

BASE_TOP_K, MAX_CONTEXT_CHUNKS, MAX_CONTEXT_CHARS, HISTORY = 3, 10, 12_000, 12
MAX_CALLEES, NODE_CHARS, DOC_CHARS, READ_CHARS, MAX_FILE_BYTES = 24, 8_000, 3_000, 400_000, 2_000_000

# Folders that a scan leaves out.
EXCLUDED_DIRS = [".git", ".venv", "venv", "__pycache__", "node_modules", "dist", "build", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".idea", ".vscode"]
