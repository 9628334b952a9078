"""Words of a text without regard to case, punctuation, markup, spacing, accents, look-alike characters and broken encoding."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts that look like a Latin letter, and the Latin letters, in pairs.
LOOK_ALIKES = (
    "аaвbеeкkмmнhоoрpсcтtуyхxіiјjѕsԁdԛqԝwһhӏlАaВbЕeКkМmНhОoРpСcТtУyХxІiЈjЅs"
    "αaβbεeηnιiκkνvοoρpτtυuχxωwΑaΒbΕeΖzΗhΙiΚkΜmΝnΟoΡpΤtΥyΧxıiłløođdħhŧtƅbɡgɑaƖl"
)
#: Letters that decompose into two.
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "Æ": "ae", "Œ": "oe", "þ": "th", "ð": "d"}

_TABLE = {ord(a): b for a, b in zip(LOOK_ALIKES[::2], LOOK_ALIKES[1::2])} | {ord(k): v for k, v in LIGATURES.items()}
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|\]\((?:https?:|/|#)[^()\s]*\)")
_BROKEN = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-™]{1,3}")
_APART = re.compile(r"[\s‒-―/|;,:_()\[\]{}<>*=+~…]+|\.{2,}|--+")
_DASH_DIGITS = re.compile(r"(?<=\d)[.,:](?=\d)")
_INSIDE = re.compile(r"[\W_]+")


def _mended(match: re.Match) -> str:
    for codec in ("cp1252", "latin-1"):
        try:
            return match.group().encode(codec).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return match.group()


def folded(text: str) -> str:
    """The text in lower case without markup, accents, look-alikes, invisible characters and broken encoding; punctuation stays."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<!--" in text:  # behind the last closing mark no comment closes
        end = text.rfind("-->") + 3
        text = _COMMENT.sub(" ", text[:end]) + text[end:] if end > 2 else text
    if "<" in text or "](" in text:
        text = _MARKUP.sub(" ", text)
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", _BROKEN.sub(_mended, text))
    text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf"))
    return text.translate(_TABLE).lower()


def words(text: str | None) -> list[str]:
    """The words of a text: parts between blanks, dashes and the like, without punctuation inside. A null text has none."""
    if not text:
        return []
    plain = _DASH_DIGITS.sub("", folded(text))
    return [w for w in (part if part.isalnum() else _INSIDE.sub("", part) for part in _APART.split(plain)) if w]
