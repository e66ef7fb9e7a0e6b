"""Character classes shared by the text rules.

Java regular expressions differ from the browser dialect the rules were
written for (``\\s`` lacks the no-break space, ``\\b`` is Unicode aware, ``$``
matches before a final newline), so each class is spelled out here once.
"""

from __future__ import annotations

# ---- fixed values -----------------------------------------------------------
# White space as the browser dialect defines it, as characters and as a class.
WS_CHARS = (
    "\t\n\x0b\f\r              "
    "    　﻿"
)
WS = (
    r"[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)
NOT_WS = WS.replace("[", "[^", 1)
# "Letter" for every boundary rule: basic Latin and Russian only.
LETTER = "[A-Za-zА-Яа-яЁё]"
LETTERS = "A-Za-zА-Яа-яЁё"
# Letter class of the recognition clean-up rules.
WORD_LETTER = "[А-яЁёa-zA-Z]"
LOWER_LETTER = "[а-яёa-z]"
# Any character but a line break, browser dialect.
DOT = r"[^\n\r\x{2028}\x{2029}]"
# Word boundary over ASCII word characters only.
ASCII_BOUNDARY = (
    "(?-i:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)
# Letters that a case-insensitive regular expression treats as equal although
# lower() leaves them apart.
FOLD_FROM = "ſıςµϐϑϕϖϰϱϵẛι"
FOLD_TO = "siσμβθφπκρεṡι"
# ---- end of fixed values ----------------------------------------------------
