"""Characters as readers see them: grapheme clusters (Unicode 15.1, UAX 29) of a text, and texts reversed by them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rewrite import as_column, let

# Code points of each kind, as hexadecimal ranges.  Java's own \X has the tables of Java's release
# and takes conjuncts apart; these tables are those of DuckDB, whose reverse() the SQL of the queries names.
CONTROL = "0-1f 7f-9f ad 61c 180e 200b 200e-200f 2028-202e 2060-2064 2066-206f feff fff9-fffb 13430-1343f 1bca0-1bca3 1d173-1d17a e0001"
PREPEND = "600-605 6dd 70f 890-891 8e2 d4e 110bd 110cd 111c2-111c3 1193f 11941 11a3a 11a84-11a89 11d46 11f02"
EXTEND = (
    "300-36f 483-489 591-5bd 5bf 5c1-5c2 5c4-5c5 5c7 610-61a 64b-65f 670 6d6-6dc 6df-6e4 6e7-6e8 6ea-6ed 711 730-74a 7a6-7b0 7eb-7f3 7fd 816-819 81b-823 825-827 829-82d "
    "859-85b 898-89f 8ca-8e1 8e3-902 93a 93c 941-948 94d 951-957 962-963 981 9bc 9be 9c1-9c4 9cd 9d7 9e2-9e3 9fe a01-a02 a3c a41-a42 a47-a48 a4b-a4d a51 a70-a71 a75 a81-a82 "
    "abc ac1-ac5 ac7-ac8 acd ae2-ae3 afa-aff b01 b3c b3e-b3f b41-b44 b4d b55-b57 b62-b63 b82 bbe bc0 bcd bd7 c00 c04 c3c c3e-c40 c46-c48 c4a-c4d c55-c56 c62-c63 c81 cbc cbf "
    "cc2 cc6 ccc-ccd cd5-cd6 ce2-ce3 d00-d01 d3b-d3c d3e d41-d44 d4d d57 d62-d63 d81 dca dcf dd2-dd4 dd6 ddf e31 e34-e3a e47-e4e eb1 eb4-ebc ec8-ece f18-f19 f35 f37 f39 "
    "f71-f7e f80-f84 f86-f87 f8d-f97 f99-fbc fc6 102d-1030 1032-1037 1039-103a 103d-103e 1058-1059 105e-1060 1071-1074 1082 1085-1086 108d 109d 135d-135f 1712-1714 1732-1733 "
    "1752-1753 1772-1773 17b4-17b5 17b7-17bd 17c6 17c9-17d3 17dd 180b-180d 180f 1885-1886 18a9 1920-1922 1927-1928 1932 1939-193b 1a17-1a18 1a1b 1a56 1a58-1a5e 1a60 1a62 "
    "1a65-1a6c 1a73-1a7c 1a7f 1ab0-1ace 1b00-1b03 1b34-1b3a 1b3c 1b42 1b6b-1b73 1b80-1b81 1ba2-1ba5 1ba8-1ba9 1bab-1bad 1be6 1be8-1be9 1bed 1bef-1bf1 1c2c-1c33 1c36-1c37 "
    "1cd0-1cd2 1cd4-1ce0 1ce2-1ce8 1ced 1cf4 1cf8-1cf9 1dc0-1dff 200c 20d0-20f0 2cef-2cf1 2d7f 2de0-2dff 302a-302f 3099-309a a66f-a672 a674-a67d a69e-a69f a6f0-a6f1 a802 a806 "
    "a80b a825-a826 a82c a8c4-a8c5 a8e0-a8f1 a8ff a926-a92d a947-a951 a980-a982 a9b3 a9b6-a9b9 a9bc-a9bd a9e5 aa29-aa2e aa31-aa32 aa35-aa36 aa43 aa4c aa7c aab0 aab2-aab4 "
    "aab7-aab8 aabe-aabf aac1 aaec-aaed aaf6 abe5 abe8 abed fb1e fe00-fe0f fe20-fe2f ff9e-ff9f 101fd 102e0 10376-1037a 10a01-10a03 10a05-10a06 10a0c-10a0f 10a38-10a3a 10a3f "
    "10ae5-10ae6 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85 11001 11038-11046 11070 11073-11074 1107f-11081 110b3-110b6 110b9-110ba 110c2 11100-11102 "
    "11127-1112b 1112d-11134 11173 11180-11181 111b6-111be 111c9-111cc 111cf 1122f-11231 11234 11236-11237 1123e 11241 112df 112e3-112ea 11300-11301 1133b-1133c 1133e 11340 "
    "11357 11366-1136c 11370-11374 11438-1143f 11442-11444 11446 1145e 114b0 114b3-114b8 114ba 114bd 114bf-114c0 114c2-114c3 115af 115b2-115b5 115bc-115bd 115bf-115c0 "
    "115dc-115dd 11633-1163a 1163d 1163f-11640 116ab 116ad 116b0-116b5 116b7 1171d-1171f 11722-11725 11727-1172b 1182f-11837 11839-1183a 11930 1193b-1193c 1193e 11943 "
    "119d4-119d7 119da-119db 119e0 11a01-11a0a 11a33-11a38 11a3b-11a3e 11a47 11a51-11a56 11a59-11a5b 11a8a-11a96 11a98-11a99 11c30-11c36 11c38-11c3d 11c3f 11c92-11ca7 "
    "11caa-11cb0 11cb2-11cb3 11cb5-11cb6 11d31-11d36 11d3a 11d3c-11d3d 11d3f-11d45 11d47 11d90-11d91 11d95 11d97 11ef3-11ef4 11f00-11f01 11f36-11f3a 11f40 11f42 13440 "
    "13447-13455 16af0-16af4 16b30-16b36 16f4f 16f8f-16f92 16fe4 1bc9d-1bc9e 1cf00-1cf2d 1cf30-1cf46 1d165 1d167-1d169 1d16e-1d172 1d17b-1d182 1d185-1d18b 1d1aa-1d1ad "
    "1d242-1d244 1da00-1da36 1da3b-1da6c 1da75 1da84 1da9b-1da9f 1daa1-1daaf 1e000-1e006 1e008-1e018 1e01b-1e021 1e023-1e024 1e026-1e02a 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef "
    "1e4ec-1e4ef 1e8d0-1e8d6 1e944-1e94a 1f3fb-1f3ff e0020-e007f e0100-e01ef"
)
SPACING = (
    "903 93b 93e-940 949-94c 94e-94f 982-983 9bf-9c0 9c7-9c8 9cb-9cc a03 a3e-a40 a83 abe-ac0 ac9 acb-acc b02-b03 b40 b47-b48 b4b-b4c bbf bc1-bc2 bc6-bc8 bca-bcc c01-c03 "
    "c41-c44 c82-c83 cbe cc0-cc1 cc3-cc4 cc7-cc8 cca-ccb cf3 d02-d03 d3f-d40 d46-d48 d4a-d4c d82-d83 dd0-dd1 dd8-dde df2-df3 e33 eb3 f3e-f3f f7f 1031 103b-103c 1056-1057 1084 "
    "1715 1734 17b6 17be-17c5 17c7-17c8 1923-1926 1929-192b 1930-1931 1933-1938 1a19-1a1a 1a55 1a57 1a6d-1a72 1b04 1b3b 1b3d-1b41 1b43-1b44 1b82 1ba1 1ba6-1ba7 1baa 1be7 "
    "1bea-1bec 1bee 1bf2-1bf3 1c24-1c2b 1c34-1c35 1ce1 1cf7 a823-a824 a827 a880-a881 a8b4-a8c3 a952-a953 a983 a9b4-a9b5 a9ba-a9bb a9be-a9c0 aa2f-aa30 aa33-aa34 aa4d aaeb "
    "aaee-aaef aaf5 abe3-abe4 abe6-abe7 abe9-abea abec 11000 11002 11082 110b0-110b2 110b7-110b8 1112c 11145-11146 11182 111b3-111b5 111bf-111c0 111ce 1122c-1122e 11232-11233 "
    "11235 112e0-112e2 11302-11303 1133f 11341-11344 11347-11348 1134b-1134d 11362-11363 11435-11437 11440-11441 11445 114b1-114b2 114b9 114bb-114bc 114be 114c1 115b0-115b1 "
    "115b8-115bb 115be 11630-11632 1163b-1163c 1163e 116ac 116ae-116af 116b6 11726 1182c-1182e 11838 11931-11935 11937-11938 1193d 11940 11942 119d1-119d3 119dc-119df 119e4 "
    "11a39 11a57-11a58 11a97 11c2f 11c3e 11ca9 11cb1 11cb4 11d8a-11d8e 11d93-11d94 11d96 11ef5-11ef6 11f03 11f34-11f35 11f3e-11f3f 11f41 16f51-16f87 16ff0-16ff1 1d166 1d16d"
)
PICTURE = (
    "a9 ae 203c 2049 2122 2139 2194-2199 21a9-21aa 231a-231b 2328 2388 23cf 23e9-23f3 23f8-23fa 24c2 25aa-25ab 25b6 25c0 25fb-25fe 2600-2605 2607-2612 2614-2685 2690-2705 "
    "2708-2712 2714 2716 271d 2721 2728 2733-2734 2744 2747 274c 274e 2753-2755 2757 2763-2767 2795-2797 27a1 27b0 27bf 2934-2935 2b05-2b07 2b1b-2b1c 2b50 2b55 3030 303d 3297 "
    "3299 1f000-1f02b 1f030-1f093 1f0a0-1f0ae 1f0b1-1f0bf 1f0c1-1f0cf 1f0d1-1f0f5 1f10d-1f10f 1f12f 1f16c-1f171 1f17e-1f17f 1f18e 1f191-1f19a 1f1ad 1f201-1f202 1f21a 1f22f "
    "1f232-1f23a 1f250-1f251 1f260-1f265 1f300-1f3fa 1f400-1f53d 1f546-1f64f 1f680-1f6d7 1f6dc-1f6ec 1f6f0-1f6fc 1f774-1f776 1f77b-1f77f 1f7d5-1f7d9 1f7e0-1f7eb 1f7f0 "
    "1f8b0-1f8b1 1f90c-1f93a 1f93c-1f945 1f947-1fa53 1fa60-1fa6d 1fa70-1fa7c 1fa80-1fa88 1fa90-1fabd 1fabf-1fac5 1face-1fadb 1fae0-1fae8 1faf0-1faf8"
)
CONSONANT = (
    "915-939 958-95f 978-97f 995-9a8 9aa-9b0 9b2 9b6-9b9 9dc-9dd 9df 9f0-9f1 a95-aa8 aaa-ab0 ab2-ab3 ab5-ab9 af9 b15-b28 b2a-b30 b32-b33 b35-b39 b5c-b5d b5f b71 c15-c28 "
    "c2a-c39 c58-c5a d15-d3a"
)
LINKER = "94d 9cd acd b4d c4d d4d"
CONJOINING = (
    "300-34e 350-36f 483-487 591-5bd 5bf 5c1-5c2 5c4-5c5 5c7 610-61a 64b-65f 670 6d6-6dc 6df-6e4 6e7-6e8 6ea-6ed 711 730-74a 7eb-7f3 7fd 816-819 81b-823 825-827 829-82d "
    "859-85b 898-89f 8ca-8e1 8e3-8ff 93c 951-954 9bc 9fe a3c abc b3c c3c c55-c56 cbc d3b-d3c e38-e3a e48-e4b eb8-eba ec8-ecb f18-f19 f35 f37 f39 f71-f72 f74 f7a-f7d f80 "
    "f82-f84 f86-f87 fc6 1037 1039-103a 108d 135d-135f 1714 17d2 17dd 18a9 1939-193b 1a17-1a18 1a60 1a75-1a7c 1a7f 1ab0-1abd 1abf-1ace 1b34 1b6b-1b73 1bab 1be6 1c37 1cd0-1cd2 "
    "1cd4-1ce0 1ce2-1ce8 1ced 1cf4 1cf8-1cf9 1dc0-1dff 200d 20d0-20dc 20e1 20e5-20f0 2cef-2cf1 2d7f 2de0-2dff 302a-302f 3099-309a a66f a674-a67d a69e-a69f a6f0-a6f1 a82c "
    "a8e0-a8f1 a92b-a92d a9b3 aab0 aab2-aab4 aab7-aab8 aabe-aabf aac1 aaf6 abed fb1e fe20-fe2f 101fd 102e0 10376-1037a 10a0d 10a0f 10a38-10a3a 10a3f 10ae5-10ae6 10d24-10d27 "
    "10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85 11070 1107f 110ba 11100-11102 11133-11134 11173 111ca 11236 112e9-112ea 1133b-1133c 11366-1136c 11370-11374 11446 1145e "
    "114c3 115c0 116b7 1172b 1183a 1193e 11943 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f42 16af0-16af4 16b30-16b36 1bc9e 1d165 1d167-1d169 1d16e-1d172 1d17b-1d182 "
    "1d185-1d18b 1d1aa-1d1ad 1d242-1d244 1e000-1e006 1e008-1e018 1e01b-1e021 1e023-1e024 1e026-1e02a 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef 1e8d0-1e8d6 1e944-1e94a"
)
JOINER, REGIONAL, LEAD, VOWEL, TRAIL = "200d", "1f1e6-1f1ff", "1100-115f a960-a97c", "1160-11a7 d7b0-d7c6", "11a8-11ff d7cb-d7fb"
SYLLABLES, OPEN = "ac00-d7a3", " ".join(f"{c:x}" for c in range(0xAC00, 0xD7A4, 28))
#: Texts of these characters alone, the ones before U+0300 and ideographs, have one in each cluster but for a line's end.
PLAIN = "0-2ff 3400-9fff"


def chars(*kinds: str, but: bool = False) -> str:
    """A character class of Java's patterns."""
    ends = [r.split("-") for kind in kinds for r in kind.split()]
    return ("[^" if but else "[") + "".join("-".join(rf"\x{{{c}}}" for c in r) for r in ends) + "]"


def cluster_pattern() -> str:
    """One cluster; any text is a row of its matches, and no run of characters is tried in two ways."""
    extend, joiner, picture, consonant, linker, lead, vowel, trail = map(chars, (EXTEND, JOINER, PICTURE, CONSONANT, LINKER, LEAD, VOWEL, TRAIL))
    cores = [
        f"{lead}*+(?:{vowel}++|(?={chars(SYLLABLES)})(?:{chars(OPEN)}{vowel}*+|.)){trail}*+", f"{lead}++", f"{trail}++", f"{chars(REGIONAL)}{{1,2}}+",
        f"{picture}(?:{extend}*+{joiner}{picture})*+",
        f"{consonant}(?:{chars(CONJOINING)}*+{linker}{chars(CONJOINING, LINKER)}*+{consonant})*+",
        chars(CONTROL, but=True),
    ]
    return rf"\r\n|{chars(CONTROL)}|{chars(PREPEND)}*(?:{'|'.join(cores)}){chars(EXTEND, SPACING, JOINER)}*+"


CLUSTER = cluster_pattern()


def clusters(c: str | Column) -> Column:
    """The grapheme clusters of a text, in order."""
    return F.regexp_extract_all(as_column(c), F.lit(CLUSTER), F.lit(0))


def reversed_text(c: str | Column) -> Column:
    """The text's clusters in reverse order, as DuckDB's reverse() has them; in ASCII alone each character is one, also those of a line's end."""
    joins = rf"{chars(PLAIN, but=True)}|(?s:[^\x00-\x7F].*\r\n|\r\n.*[^\x00-\x7F])"
    return let(c, lambda x: F.when(x.rlike(joins), F.array_join(F.reverse(clusters(x)), "")).otherwise(F.reverse(x)))
