"""Rules as data: vocabularies, layer rules, language tables, palettes.

All literals here are fixed values: they must equal the published behaviour for
results to match, so they are stated plainly.
"""

from __future__ import annotations

# The seven text fields of an element, in order.
FIELDS = ["description", "diagram", "constraint", "concern", "context", "todo", "note"]

# File name of each field; diagrams have several formats.
FIELD_FILES = {
    "description.md": "description",
    "constraint.md": "constraint",
    "concern.md": "concern",
    "context.md": "context",
    "todo.md": "todo",
    "note.md": "note",
}

# Diagram file names by priority, with their format.
DIAGRAM_FILES = [
    ("diagram.mmd", "flowchart"),
    ("diagram.mermaid", "flowchart"),
    ("diagram.puml", "sequence"),
    ("diagram.plantuml", "sequence"),
]

# Search weight of each field.
FIELD_WEIGHT = {
    "description": 4.0,
    "context": 2.5,
    "constraint": 2.0,
    "concern": 1.5,
    "diagram": 1.0,
    "todo": 1.0,
    "note": 0.5,
}

# Extensions of each language, in registration order.
LANGUAGE_EXTENSIONS = {
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "typescript": [".ts", ".tsx", ".mts", ".cts"],
    "java": [".java"],
    "kotlin": [".kt", ".kts"],
    "scala": [".scala", ".sc"],
    "python": [".py", ".pyw", ".pyi"],
    "go": [".go"],
    "rust": [".rs"],
}
EXTENSION_LANGUAGE = {e: lang for lang, exts in LANGUAGE_EXTENSIONS.items() for e in exts}
SUPPORTED_EXTENSIONS = list(EXTENSION_LANGUAGE)
# Extensions an import may spell out.
IMPORT_EXTENSIONS = sorted({".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".mts", ".cts", *SUPPORTED_EXTENSIONS})

# Layer rules used for violations, first match wins.
VIOLATION_LAYERS = [
    ("ui", ["renderer", "components", "views", "pages", "ui", "frontend", "client"]),
    ("api", ["api", "routes", "controllers", "handlers", "server"]),
    ("service", ["services", "service", "business", "logic", "use-cases"]),
    ("data", ["data", "db", "database", "repository", "repos", "models", "store", "dao"]),
    ("infra", ["infra", "infrastructure", "utils", "helpers", "lib", "common", "shared"]),
]
# The wider rules used for the layer summary.
SUMMARY_LAYERS = [
    ("ui", ["renderer", "components", "views", "pages", "ui", "frontend", "client", "web-ui"]),
    ("api", ["api", "routes", "controllers", "handlers", "server", "rest-api", "channel"]),
    ("service", ["services", "service", "business", "logic", "use-cases", "pipeline", "routing"]),
    ("data", ["data", "db", "database", "repository", "repos", "models", "store", "dao", "adapter", "persistence"]),
    ("infra", ["infra", "infrastructure", "utils", "helpers", "lib", "common", "shared", "config"]),
]

# Substrings that make a path a test file.
TEST_MARKERS = ["test", "spec", "__tests__"]

# Directories never scanned (any name starting with a dot is
# skipped as well, so only the undotted names are listed).
IGNORED_DIRS = [
    "node_modules", "dist", "build", "coverage", "__pycache__", "venv", "env",
    "target", "bin", "obj", "graphify-out",
]
# Generated files never analysed.
GENERATED_FILES = [r"\.min\.", r"\.bundle\.", r"\.chunk\.", r"\.d\.ts$", r"\.d\.mts$"]
# Path parts whose change events a watch drops.
WATCH_IGNORED = ["node_modules", ".git", "dist", "build", "coverage", ".next", ".nuxt", "__pycache__", ".venv"]

# Diagram class names and their colours.
CLASSDEF_PALETTE = {
    "external": {"fill": "#585b70", "stroke": "#585b70", "color": "#cdd6f4"},
    "concern": {"fill": "#f38ba8", "stroke": "#f38ba8", "color": "#1e1e2e"},
    "entry": {"fill": "#89b4fa", "stroke": "#89b4fa", "color": "#1e1e2e"},
    "store": {"fill": "#a6e3a1", "stroke": "#a6e3a1", "color": "#1e1e2e"},
}
# Words a diagram node may not be named (compared in lower case;
# the two camelCase words of the published list can therefore never match).
RESERVED_WORDS = ["graph", "flowchart", "subgraph", "end", "class", "click", "style", "direction", "interpolate"]
# Perspectives that may reference other perspectives.
HUB_PERSPECTIVES = ["overall-architecture", "architecture"]

# The line grammar of diagrams, each pattern whole.
SKIP_LINE = r"(?i)^(graph|flowchart|sequenceDiagram|classDiagram|erDiagram|gantt|pie|gitGraph|classDef|class |click |style |linkStyle|subgraph|end$)"
STRICT_EDGE = r"^(\S+?)(?:\[.*?\]|\(.*?\)|\{.*?\}|>.*?\])?\s*(-->|--o|--x|---|-.->|==>|~~>|--\|.*?\|)\s*(\S+?)(?:\[.*?\]|\(.*?\)|\{.*?\}|>.*?\])?$"
BROAD_EDGE = r"^([^\s\[\](\{]+).*?(-->|--o|--x|---|-.->|==>|~~>).*?([^\s\[\](\{]+).*$"
NODE_LINE = r"^([^\s\[\](\{]+)[\[(\{].*$"
GRAPH_DECLARATION = r"(?i)^(graph|flowchart)\s+(LR|RL|TD|TB|BT)\s*$"
DIRECTIVE_LINE = r"(?i)^(graph|flowchart|classDef|class |click |style |linkStyle|subgraph|end$|%%)"
FLOW_LABEL_EDGE = r'^(.+?)\s+--\s+"([^"]+)"\s+-->\s+(.+)$'
FLOW_EDGE = r"^(.*?)(-->(?:\|[^|]*\|)?|--o|--x|---|-.->|==>|~~>)(.*?)(?:(?:-->(?:\|[^|]*\|)?|--o|--x|---|-.->|==>|~~>).*)?$"
FLOW_DIRECTION = r"(?i)^(?:graph|flowchart)\s+([A-Z]{2}).*$"
FLOW_SKIP = r"(?i)^(classDef|click |style |linkStyle|subgraph|end$)"
FLOW_CLASS = r"^class\s+([\w\-,\s]+)\s+(\w+)$"
