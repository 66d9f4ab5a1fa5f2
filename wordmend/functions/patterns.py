"""The word rules, file extensions and defaults the results depend on."""

from __future__ import annotations

# --- word rules ------------------------------------------------------------------------

# One letter or apostrophe with its combining marks. ASCII is tried first because it is
# much cheaper than grapheme matching and needs no marks.
_LETTER = r"(?:[A-Za-z'](?=[\x00-\x7F]|\z)|(?=[\p{IsAlphabetic}'&&[^\p{M}]])\X)"
_LETTER_NOT_UPPER = (
    r"(?:[a-z'](?=[\x00-\x7F]|\z)|(?=[\p{IsAlphabetic}'&&[^\p{M}\p{IsUppercase}]])\X)"
)
# A part of a plain-text word: words end at anything but a letter, apostrophe or hyphen,
# and compounds split at hyphens and in front of capitals. (A combining mark on a hyphen is
# treated as part of the hyphen.)
PLAIN_PART = _LETTER + _LETTER_NOT_UPPER + "*+"
MARKDOWN_WORD = r"[\p{IsAlphabetic}'\-]++"
CODE_WORD = r"\p{IsAlphabetic}++"

_REST_OF_WORD = r"[\p{IsAlphabetic}\p{M}'\-\x{200C}\x{200D}]*+"
# A stretch of a long line, or of a very long text, that does not end inside a word.
SEGMENT = r"(?s).{1,2000}+" + _REST_OF_WORD
SHORT_LINE_BYTES = 4000
BIG_SEGMENT = r"(?s).{1,500000}+" + _REST_OF_WORD
SHORT_TEXT_BYTES = 1_000_000

# --- source code -----------------------------------------------------------------------

# String literals of C-like languages run to the closing quote or the end of the line.
C_STRING = (
    r"""(?s)"(?:[^"\\]++|\\.)*+(?:"|\\?\z)|'(?:[^'\\]++|\\.)*+(?:'|\\?\z)"""
)
# Python literals must be closed on their line.
PYTHON_STRING = r"""(?s)"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'"""
ESCAPE_PAIR = r"(?s)\\(?:.|\z)"

# --- file types ------------------------------------------------------------------------

# Lower-cased file extensions.
MARKDOWN_EXTENSIONS = ("md", "mdx", "markdown")
SOURCE_EXTENSIONS = {
    "rust": ("rs",),
    "javascript": ("js", "mjs", "cjs"),
    "typescript": ("ts", "mts", "cts"),
    "jsx": ("jsx",),
    "tsx": ("tsx",),
    "python": ("py", "pyw"),
    "go": ("go",),
    "java": ("java",),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hh"),
}

# --- ignore rules ----------------------------------------------------------------------

# Words (or regions of text) that are never misspellings.
ALL_CAPS = r"\b[A-Z0-9_]{2,}\b"
URL = r"https?://\S+"
HEX_HASH = r"\b[a-fA-F0-9]{32,}\b"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
DEFAULT_IGNORE = (ALL_CAPS, URL, HEX_HASH, EMAIL)
# The rules that can only match text longer than one word.
DEFAULT_REGIONS = (URL, EMAIL)

# --- suggestions -----------------------------------------------------------------------

# Typed letter -> letter probably meant, one direction only.
COMMON_TYPOS = (
    ("a", "e"),
    ("e", "i"),
    ("i", "o"),
    ("o", "u"),
    ("b", "v"),
    ("c", "k"),
    ("f", "v"),
    ("g", "j"),
    ("m", "n"),
    ("s", "z"),
    ("t", "d"),
)
MAX_SUGGESTIONS = 5
SHORT_WORD = 3
SHORT_WORD_CANDIDATES = 100

# The word list used before a dictionary is installed.
BUILTIN_ENGLISH = """
the be to of and a in that have i it for not on with he as you do at this but his by from
they we say her she or an will my one all would there their what so up out if about who get
which go me when make can like time no just him know take people into year your good some
could them see other than then now look only come its over think also back after use two how
our work first well way even new want because any these give day most us
function class method variable string integer boolean array list dictionary object parameter
return import export async await promise callback error exception test debug compile build
deploy version configuration
"""
BUILTIN_OTHER = "the be to of and a in that have i"
ENGLISH = ("en_US", "en_GB")
