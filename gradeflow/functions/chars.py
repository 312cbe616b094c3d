"""Character sets shared by the text functions.

Spark's own ``trim`` and Java's ``\\s``/``\\w`` differ from what the evaluation
rules mean by white space and word characters, so the sets are spelled out once
here and every pattern is built from them.  The ``\\x{...}`` notation is read the
same way by Java and by RE2.
"""

# The characters treated as white space when trimming or matching.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set as the inside of a character class.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# Word characters (any letter, any number, underscore).
WORD = r"\p{L}\p{N}_"

# Letters that a case-insensitive A-Z accepts.
LETTER = r"[A-Za-z\x{130}\x{131}\x{17f}\x{212a}]"

# The CJK range kept by text cleaning and tokenising.
CJK = r"\x{4e00}-\x{9fa5}"
