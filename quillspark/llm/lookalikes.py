"""Fixed tables of characters that look alike, for comparisons of what a reader sees."""

from __future__ import annotations

# Characters that show nothing.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁥⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯ㅤ︀︁︎️﻿ﾠ"
# Letters of other scripts, and variants, drawn like the Latin letter before them.
LATIN_TWINS = """
A Α А Ꭺ ᗅ
B Β В Ᏼ ᗷ
C С Ϲ Ꮯ
D Ꭰ ᗞ
E Ε Е Ꭼ
F Ϝ ᖴ
G Ԍ Ꮐ
H Η Н Ꮋ ᕼ
I Ι І Ӏ
J Ј Ϳ Ꭻ
K Κ К Ꮶ K
L Ꮮ ᒪ
M Μ М Ꮇ ᗰ
N Ν
O Ο О Օ
P Ρ Р Ꮲ ᑭ
Q Ԛ
R Ꭱ Ꮢ ᖇ
S Ѕ Տ Ꮪ
T Τ Т Ꭲ
U Ս
V Ѵ Ꮩ ᐯ
W Ԝ Ꮃ
X Χ Х
Y Υ Ү
Z Ζ Ꮓ
a а ɑ
c с ϲ
d ԁ
e е
g ɡ ց
h һ հ
i і ı ι
j ј ϳ
l ӏ
n ո
o о ο օ
p р ρ
q ԛ
s ѕ
u υ ս
v ν ѵ
w ԝ
x х
y у ү
Đ Ð Ɖ
đ ɖ
Ë Ё
ë ё
Ï Ї
ï ї
"""
# Letters drawn alike in scripts other than Latin, each row one look.
OTHER_TWINS = """
Γ Г
Π П
Φ Ф
へ ヘ
"""
# Blanks, hyphens and other marks drawn alike, in rows.
MARK_TWINS = [
    " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\t",
    "-\u2010\u2011\u2012\u2013\ufe63\uff0d\u2043\u2212",
    "'\u02bc\uff07",
]
LATIN = {ord(c): w[0] for w in map(str.split, LATIN_TWINS.splitlines()) if w for c in w[1:]}
#: Capitals that look like one Latin letter while their small form looks like another: both looks count, but not together.
_SMALL = {c: w[0] for w in map(str.split, LATIN_TWINS.splitlines()) if w for c in w[1:] if w[0].islower()}
TWO_FACED = {ord(c): w[0] for w in map(str.split, LATIN_TWINS.splitlines()) if w for c in w[1:] if _SMALL.get(c.casefold(), w[0].casefold()) != w[0].casefold()}
