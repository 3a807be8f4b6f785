"""One regular-expression dialect for all rules.

Rules follow the ECMAScript reading of their text: ``\\b`` and ``\\w`` are
ASCII, ``\\s`` is the Unicode white space below, ``i`` folds Unicode. Java and
RE2 read each of these differently, so rules are written with the pieces here.
"""

from __future__ import annotations

#: The white space of the dialect, as the inside of a character class.
SPACES = r"\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WS = f"[{SPACES}]"
WORD = "[A-Za-z0-9_]"
#: A boundary before, after a character that is known to be a word character.
LEAD, TRAIL = f"(?<!{WORD})", f"(?!{WORD})"
#: A boundary between any characters.
BOUNDARY = f"(?:{LEAD}(?={WORD})|(?<={WORD}){TRAIL})"
