"""Patterns for C text.  All loops are possessive or over one character class,
so that the JVM matcher stays iterative on long comments and literals."""

BLOCK_COMMENT = r"/\*[\s\S]*?(?:\*/|\z)"
LINE_COMMENT = r"//(?:[^\n\\]++|\\[\s\S]|\\)*+"
# A preprocessor line with continuations; a block comment in it may span lines.
DIRECTIVE = (r"(?m:^)[ \t]*+#(?:[^\n\\/]++|\\[\s\S]|/\*[\s\S]*?\*/|"
             + LINE_COMMENT + r"|/)*+")
STRING = r'"(?:[^"\\\n]++|\\[\s\S])*+"'
CHAR = r"'(?:[^'\\\n]++|\\[\s\S])*+'"

# Coarse pieces: their concatenation is the whole text again.
PIECE = "|".join([
    BLOCK_COMMENT, LINE_COMMENT, DIRECTIVE, STRING, CHAR,
    r"\s*\n",                       # line ends, with blank lines
    r"[{};()]",                     # structure
    r"[^\n{};()\"'/#]++",           # anything else up to the next of these
    r"[\s\S]",
])

# The pieces among them that may hold the characters which cut the others, for the bytes of a text in
# Python's dialect.  A directive comes with the line end in front of it, so that a search can look for
# first bytes; behind terminators other than LF it has no blanks in front.
FIRST_DIRECTIVE = DIRECTIVE.removeprefix(r"(?m:^)")
_DIRECTIVE_BODY = DIRECTIVE.removeprefix(r"(?m:^)[ \t]*+")
CONSTRUCT = "|".join([
    BLOCK_COMMENT, LINE_COMMENT, STRING, CHAR, r"\n" + FIRST_DIRECTIVE,
    *[end + _DIRECTIVE_BODY for end in (r"\r", r"\xC2\x85", r"\xE2\x80[\xA8\xA9]")],
]).replace(r"\z", r"\Z")

# Fine tokens of one declaration or function head.  Group 1 is the token, the
# whole match also holds the blanks, comments and directives before it.
# (In such text "#" outside of literals only starts a directive.)
TRIVIA = (rf"(?:\s++|{BLOCK_COMMENT}|{LINE_COMMENT}|"
          + DIRECTIVE.removeprefix(r"(?m:^)[ \t]*+") + ")*+")
TOKEN = rf"{TRIVIA}([A-Za-z_]\w*+|\d[\w.]*+|{STRING}|{CHAR}|\.\.\.|->|[^\s])"
TRIVIA_AT_START = rf"^{TRIVIA}"

WORD = r"^[A-Za-z_]"

# Words that may stand before "(" without being a call.
NOT_CALLED = [
    "if", "for", "while", "switch", "return", "sizeof", "case", "do", "else", "goto",
    "defined", "typeof", "__typeof__", "_Alignof", "alignof", "__alignof__", "_Generic",
    "__attribute__", "__attribute", "__asm__", "__asm", "asm", "__declspec", "offsetof",
]
# Words that take an argument list but are no part of a declarator.
ATTRIBUTE_WORDS = [
    "__attribute__", "__attribute", "__declspec", "__asm__", "__asm", "asm",
    "_Alignas", "alignas", "__typeof__", "typeof", "__extension__",
]
TAG_WORDS = ["struct", "union", "enum"]
