"""Text patterns that must equal the source tool's for equal results.

Python syntax. Column code passes them through ``text.java``; the offset
scanner compiles them with ``re``.
"""

# Markdown documents
TITLE = r"^#\s+(.+)$"
PARAGRAPH_AFTER_TITLE = r"\A#.*?\n+(.+?)(\n\n|\n#|\Z)"
HEADING = r"^(#+)\s+(.+?)$"
IMPORT_LINE = r"^from\s+.*?\s+import\s+.*?$|^import\s+.*?$"
CODE_FENCE = r"```(?:python)?\s*(.*?)\s*```"
CALL = r"[a-zA-Z0-9_]+\(.*?\)"

# Python sources
FUNCTION = r"def\s+([a-zA-Z0-9_]+)\s*\((.*?)\)(?:\s*->\s*([a-zA-Z0-9_\[\]\.\'\"<>, ]+))?\s*:"
CLASS_HEADER = r"class\s+([a-zA-Z0-9_]+)(?:\(([a-zA-Z0-9_., \[\]\'\"]+)\))?:"
CLASS_WITH_BODY = CLASS_HEADER + r"(.*?)(?=class|\Z)"
DECORATOR = r"^\s*@[a-zA-Z0-9_\.]+.*$"
DOCSTRING = r'"""(.*?)"""'
MODULE_IMPORT = r"^(?:from|import)\s+.*?$"
TYPED_PARAMETER = r"([a-zA-Z0-9_]+)\s*:\s*([a-zA-Z0-9_\[\]\.\'\"<>, ]+)(?:\s*=\s*(.+))?"
PLAIN_PARAMETER = r"([a-zA-Z0-9_]+)(?:\s*=\s*(.+))?"
PLAIN_FUNCTION = r"def\s+([a-zA-Z0-9_]+)\s*\((.*?)\):(.*?)(?=def|\Z)"
PLAIN_CLASS = r"class\s+([a-zA-Z0-9_]+).*?:(.*?)(?=class|\Z)"
COMMENT = r"#\s*(.*?)$"

# Docstring sections
PARAMETER_SECTION = r"(?:Args|Parameters):(.*?)(?:Returns:|Raises:|Yields:|Examples:|$)"
PARAMETER_ENTRY = (
    r"([a-zA-Z0-9_]+)(?:\s*\((.*?)\))?\s*:(.*?)"
    r"(?=\n\s*[a-zA-Z0-9_]+\s*(?:\(.*?\))?\s*:|$)"
)
RETURN_SECTION = r"Returns:(.*?)(?:Raises:|Yields:|Examples:|$)"
TYPED_RETURN = r"([a-zA-Z0-9_\[\]\.\'\"<>, ]+):\s*(.*)"
EXAMPLE_SECTION = r"Examples?(.*?)(?:$)"

# Character windows
METHOD_WINDOW = 200
DECORATOR_WINDOW = 200
