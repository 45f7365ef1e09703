"""What a file's extension says, by purpose. The tables are fixed values."""

from __future__ import annotations

# Extension to language, for parsing.
PARSER = {
    ".py": "python", ".js": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".cjsx": "javascript", ".mjs": "javascript", ".mjsx": "javascript",
    ".ts": "typescript", ".cts": "typescript", ".mts": "typescript", ".tsx": "typescript", ".ctsx": "typescript", ".mtsx": "typescript",
    ".go": "go", ".rs": "rust", ".java": "java", ".php": "php", ".cs": "c_sharp", ".c": "c",
    ".h": "cpp", ".hh": "cpp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp",
    ".html": "html", ".htm": "html", ".css": "css", ".scss": "scss", ".sass": "css", ".less": "css", ".stylus": "css", ".styl": "css",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".vue": "vue", ".svelte": "svelte", ".ex": "elixir", ".exs": "elixir", ".rb": "ruby",
    ".kt": "kotlin", ".kts": "kotlin", ".dart": "dart", ".swift": "swift", ".r": "r", ".R": "r",
    ".md": "markdown", ".markdown": "markdown", ".mdx": "markdown",
}

# Where statistics differ from parsing. R files count as other.
STATS = {k: v for k, v in PARSER.items() if v != "r"} | {".cs": "csharp", ".scss": "css", ".sh": "shell", ".bash": "shell", ".zsh": "shell"}

# Extensions that routes are extracted from.
ROUTES = {
    ".py": "python", ".js": "javascript", ".cjs": "javascript", ".cjsx": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".mjsx": "javascript",
    ".ts": "typescript", ".cts": "typescript", ".mts": "typescript", ".tsx": "typescript", ".ctsx": "typescript", ".mtsx": "typescript",
    ".php": "php", ".go": "go", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".cs": "csharp", ".rb": "ruby", ".ex": "elixir", ".exs": "elixir", ".rs": "rust",
}

# Extensions that a result's quality doesn't know.
SURFACE = {k: v for k, v in STATS.items() if k not in (".mts", ".cts", ".cjsx", ".mjsx", ".mtsx", ".ctsx", ".hh", ".hxx")}

# Extensions whose calls are extracted.
CALLS = {".py", ".js", ".cjs", ".cjsx", ".mjs", ".mjsx", ".ts", ".cts", ".mts", ".tsx", ".ctsx", ".mtsx", ".go", ".rs", ".java", ".kt", ".kts", ".dart", ".swift", ".r", ".R"}

# Colours of diagram nodes by extension.
COLORS = {
    ".py": "#3572A5", ".js": "#f1e05a", ".cjs": "#f1e05a", ".cjsx": "#f1e05a", ".jsx": "#f1e05a", ".mjs": "#f1e05a", ".mjsx": "#f1e05a",
    ".ts": "#2b7489", ".cts": "#2b7489", ".mts": "#2b7489", ".tsx": "#2b7489", ".ctsx": "#2b7489", ".mtsx": "#2b7489", ".go": "#00ADD8", ".rs": "#dea584",
    ".html": "#e34c26", ".htm": "#e34c26", ".css": "#563d7c", ".scss": "#c6538c", ".sass": "#c6538c", ".less": "#1d365d", ".stylus": "#ff6347", ".styl": "#ff6347",
    ".sh": "#89e051", ".bash": "#89e051", ".zsh": "#89e051", ".svelte": "#ff3e00",
}
NO_COLOR = "#cccccc"

# Names by which fenced code blocks state their language, beside the plain extensions.
FENCES = {"python": ".py", "javascript": ".js", "typescript": ".ts", "golang": ".go", "rust": ".rs", "csharp": ".cs", "c#": ".cs", "c++": ".cpp", "shell": ".sh", "elixir": ".ex", "ruby": ".rb", "kotlin": ".kt"}


def fence_extension(info: str) -> str | None:
    """The extension of a fenced block's info string; blocks of page templates, exs, h, r and Markdown aren't parsed."""
    word = info.strip().split()[0].lower() if info.strip() else ""
    if word in FENCES:
        return FENCES[word]
    return f".{word}" if f".{word}" in PARSER and word not in ("vue", "exs", "h", "r", "md", "markdown", "mdx") else None
