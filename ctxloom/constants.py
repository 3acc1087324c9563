"""Fixed values that must equal the original tool's for identical results, and
the names of files on disk (parameters of ours).

FIXED VALUES (kept as plain text, in natural order):
"""

from dataclasses import dataclass

# Limits.
MAX_FILES = 10_000                 # files loaded per project
MAX_PER_FILE_BYTES = 512 * 1024    # head + tail cap per file in a document
SNIFF_BYTES = 1024                 # binary sniff window
TOKEN_BUDGET = 200_000             # budget shown next to the estimate
HEAD_LINES = 1000                  # command output lines kept at the head
TAIL_LINES = 1000                  # command output lines kept at the tail
MAX_HISTORY = 50                   # command history entries
WRAP_COLUMNS = 80                  # HTML to text wrap width

# Rules used when a project has no readable ignore file.
DEFAULT_IGNORE_GLOBS = ["**/target/**", "**/.git/**", "**/node_modules/**", "**/*.tmp"]

# Marker texts.
BINARY_MARKER = "[binary file omitted]\n"
TRUNCATED_MARKER = "\n[... truncated ...]\n"
READ_ERROR_MARKER = "[error reading file]\n"
OUTPUT_TRUNCATED_MARKER = "[... output truncated ...]"
UNREADABLE_ERROR = 'Error { kind: InvalidData, message: "stream did not contain valid UTF-8" }'

# Tree drawing.
TREE_BRANCH = "├─ "
TREE_LAST = "└─ "
TREE_PIPE = "│   "
TREE_BLANK = "    "
TREE_ROOT_FALLBACK = "root"

# File classes by name suffix, first match wins.
FILE_CLASSES = [
    ("Rust", [".rs"]),
    ("Markdown/Text", [".md", ".txt"]),
    ("CUDA", [".cu", ".cuda"]),
    ("Object", [".o"]),
    ("Python", [".py"]),
    ("HTML", [".html"]),
    ("CSS", [".css"]),
    ("CSV", [".csv"]),
    ("Slang", [".slang"]),
    ("WGSL", [".wgsl"]),
    ("Images", [".png", ".exr", ".hdr", ".jpg", ".jpeg"]),
    ("GLTF", [".gltf", ".glb"]),
    ("SPIR-V", [".spv", ".spvasm"]),
    ("GLSL/Compute", [".glsl", ".comp"]),
    ("Shell", [".sh"]),
    ("Lock", [".lock"]),
    ("TOML", [".toml"]),
]
OTHER_CLASS = "other"

# Document tags, in document order.
TAG_INSTRUCTION_OPEN, TAG_INSTRUCTION_CLOSE = "<instruction>", "</instruction>\n"
TAG_TREE_OPEN, TAG_TREE_CLOSE = "<file_tree>\n", "\n</file_tree>\n"
TAG_CODE_OPEN, TAG_CODE_CLOSE = "<code>\n", "</code>\n\n"
TAG_FILE_OPEN, TAG_FILE_CLOSE = '<file path="', "</file>\n"
TAG_COMMAND_OPEN, TAG_COMMAND_CLOSE = "<terminal_command>", "</terminal_command>\n"
TAG_OUTPUT_OPEN, TAG_OUTPUT_CLOSE = "<terminal_output>", "</terminal_output>\n"
CDATA_OPEN, CDATA_CLOSE, CDATA_SPLIT = "<![CDATA[", "]]>", "]]]]><![CDATA[>"


@dataclass(frozen=True)
class DiskNames:
    """Where a project keeps its own files, relative to its folder.  Not fixed
    values: pass others to the sources to read an existing workspace."""
    rule_file: str = ".ctxloom/ignore"            # preferred at one level
    rule_file_legacy: str = ".ctxignore"
    system_file: str = ".ctxloom/system.txt"
    addon_file: str = ".ctxloom/system_addon.txt"
    history_file: str = ".ctxloom/terminal_history.json"


NAMES = DiskNames()


@dataclass(frozen=True)
class Wording:
    """How a document names its system text, and what stands there when it could
    not be loaded.  Not fixed values: pass others to write another tool's documents."""
    system_tag: str = "system"
    system_missing: str = "No system text found. Tried: "
    system_failed: str = "The system text could not be loaded; tell the user. error: "

    @property
    def system_open(self) -> str:
        return f"<{self.system_tag}>\n"

    @property
    def system_close(self) -> str:
        return f"\n</{self.system_tag}>\n"


WORDS = Wording()
