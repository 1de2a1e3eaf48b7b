"""Which elements of a page its stylesheets switch off or on: the cascade of display and visibility.

Rules are read with their nesting. Media queries are answered for a scripted desktop screen. Selectors
are compounds of tag, class, id, attribute, :is, :where, :not, :root and :link, joined by descendant and
child combinators. Selectors with states (:hover) or pseudo-elements match nothing at rest. Those with
sibling combinators or :nth-child and the like do not count, nor do rules in @container and @scope.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: The screen that media queries are answered for, in CSS pixels.
WIDTH, HEIGHT = 1280, 800
#: Selectors of one nested rule, after those around it are put in; a rule with more does not count.
NESTED = 4096
PIXELS = {"": 1.0, "px": 1.0, "em": 16.0, "rem": 16.0, "ex": 8.0, "ch": 8.0, "in": 96.0, "pt": 96 / 72, "pc": 16.0, "cm": 96 / 2.54, "mm": 9.6 / 2.54, "q": 2.4 / 2.54, "vw": WIDTH / 100, "vh": HEIGHT / 100}
FEATURES = {
    "orientation": {"landscape"}, "hover": {"hover"}, "any-hover": {"hover"}, "pointer": {"fine"}, "any-pointer": {"fine"}, "scripting": {"enabled"},
    "prefers-color-scheme": {"light"}, "prefers-reduced-motion": {"no-preference"}, "prefers-contrast": {"no-preference"}, "prefers-reduced-transparency": {"no-preference"},
    "prefers-reduced-data": {"no-preference"}, "forced-colors": {"none"}, "inverted-colors": {"none"}, "display-mode": {"browser"}, "update": {"fast"},
    "scan": {"progressive"}, "grid": {"0"}, "overflow-block": {"scroll"}, "overflow-inline": {"scroll"}, "color-gamut": {"srgb"}, "dynamic-range": {"standard"},
}
PLAIN = frozenset("width height aspect-ratio resolution color orientation hover any-hover pointer any-pointer scripting".split())
TOKEN = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*+\"?|'(?:\\.|[^'\\\n])*+'?|url\([ \t\n\f\r]*+[^\"'() \t\n\f\r][^)]*+\)?|\\.|<!--|-->|[{};()\[\]]|[^\"'\\/{};()\[\]u<-]++|.", re.S | re.I)
DISPLAY = re.compile(
    r"(?:none|contents|(?:block|inline|run-in|flow|flow-root|table|flex|grid|ruby|math|list-item)(?: (?:block|inline|run-in|flow|flow-root|table|flex|grid|ruby|math|list-item))*|inline-(?:block|table|flex|grid)|table-(?:row|cell|column|caption|row-group|header-group|footer-group|column-group)|ruby-(?:base|text)(?:-container)?|-(?:webkit|moz)-(?:inline-)?(?:box|flex)|initial|inherit|unset|revert|revert-layer|var\(.*)",
    re.S,
)
VISIBILITY = re.compile(r"visible|hidden|collapse|initial|inherit|unset|revert|revert-layer")
IDENT = r"(?:[\w-]|[^\x00-\x7f]|\\[0-9a-fA-F]{1,6}[ \t\n]?|\\[^0-9a-fA-F\n])+"
PART = re.compile(
    rf"(?P<tag>{IDENT}|\*)|\.(?P<kind>{IDENT})|\#(?P<id>{IDENT})|\[\s*(?P<key>{IDENT})\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<v1>[^\"]*)\"|'(?P<v2>[^']*)'|(?P<v3>{IDENT}))\s*(?P<flag>[iIsS])?\s*)?\]"
    r"|:(?P<pseudo>:?[\w-]+)(?P<args>\()?"
)
COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
RESTING = frozenset("hover focus active focus-within focus-visible target target-within visited fullscreen modal popover-open before after first-line first-letter user-invalid user-valid autofill playing".split())


class Unread(ValueError):
    """A selector that is not understood."""


@dataclass
class Compound:
    """One element's conditions."""

    tag: str = ""
    kinds: list[str] = field(default_factory=list)
    ids: list[str] = field(default_factory=list)
    keys: list[tuple[str, str, str, bool]] = field(default_factory=list)
    some: list[list[Compound]] = field(default_factory=list)
    none: list[Compound] = field(default_factory=list)
    root: bool = False
    link: bool = False
    never: bool = False
    weight: tuple[int, int, int] = (0, 0, 0)

    def meets(self, name: str, attributes: dict[str, str]) -> bool:
        if self.never or (self.tag and self.tag != name and not (name == "#root" and self.tag in ("html", "body"))):
            return False
        if self.kinds and not set(self.kinds) <= set(attributes.get("class", "").split()):
            return False
        if any(attributes.get("id") != i for i in self.ids) or (self.root and name not in ("html", "#root")) or (self.link and not (name in ("a", "area") and "href" in attributes)):
            return False
        for key, op, value, fold in self.keys:
            if key not in attributes:
                return False
            have = attributes[key] or ""
            if fold:
                have, value = have.lower(), value.lower()
            if op and not {"=": have == value, "~=": value in have.split(), "|=": have == value or have.startswith(value + "-"), "^=": bool(value) and have.startswith(value), "$=": bool(value) and have.endswith(value), "*=": bool(value) and value in have}[op]:
                return False
        return all(any(c.meets(name, attributes) for c in group) for group in self.some) and not any(c.meets(name, attributes) for c in self.none)


def _plain(ident: str) -> str:
    return re.sub(r"\\(?:([0-9a-fA-F]{1,6})[ \t\n]?|(.))", lambda m: m[2] or (chr(int(m[1], 16)) if 0 < int(m[1], 16) < 0x110000 else "�"), ident) if "\\" in ident else ident


def split_at(text: str, sign: str) -> list[str]:
    """Parts between signs that are outside of brackets and strings."""
    out, depth, part = [], 0, []
    for m in TOKEN.finditer(text):
        t = m[0]
        depth += (t in "([") - (t in ")]") if len(t) == 1 else 0
        if depth == 0 and len(t) > 1 and sign in t and t[0] not in "\"'\\/" and not t.lower().startswith("url("):
            head, *more = t.split(sign)
            part.append(head)
            for p in more:
                out.append("".join(part))
                part = [p]
        elif depth == 0 and t == sign:
            out.append("".join(part))
            part = []
        elif not t.startswith("/*"):
            part.append(t)
    return [*out, "".join(part)]


def _compound(text: str, at: int, level: int) -> tuple[Compound, int]:
    c, first = Compound(), at
    a, b, d = 0, 0, 0
    while (m := PART.match(text, at)) and not (m["tag"] and at > first):
        at = m.end()
        if m["tag"]:
            c.tag = "" if m["tag"] == "*" else _plain(m["tag"]).lower()
            d += m["tag"] != "*"
        elif m["kind"]:
            c.kinds.append(_plain(m["kind"]))
            b += 1
        elif m["id"]:
            c.ids.append(_plain(m["id"]))
            a += 1
        elif m["key"]:
            c.keys.append((_plain(m["key"]).lower(), m["op"] or "", m["v1"] or m["v2"] or _plain(m["v3"] or ""), (m["flag"] or "").lower() == "i"))
            b += 1
        else:
            pseudo = m["pseudo"].lower()
            inner = ""
            if m["args"]:
                depth, end = 1, at
                while end < len(text) and depth:
                    depth += (text[end] == "(") - (text[end] == ")")
                    end += 1
                inner, at = text[at : end - 1], end
            if pseudo.startswith(":") or pseudo in RESTING:
                c.never = True
                b += 1
            elif pseudo == "root":
                c.root = True
                b += 1
            elif pseudo in ("link", "any-link"):
                c.link = True
                b += 1
            elif pseudo in ("is", "where", "matches", "not") and inner and level < 8:
                group = []
                for s in split_at(inner, ","):
                    s = s.strip()
                    one, end = _compound(s, 0, level + 1)
                    if end != len(s):
                        raise Unread(text)
                    group.append(one)
                if pseudo == "not":
                    c.none += group
                else:
                    c.some.append(group)
                if pseudo != "where":
                    w = max(g.weight for g in group)
                    a, b, d = a + w[0], b + w[1], d + w[2]
            else:
                raise Unread(text)
    if at == first:
        raise Unread(text)
    c.weight = (a, b, d)
    return c, at


@dataclass
class Selector:
    """Compounds from the right to the left; child[k]: whether the next is the parent and not just an ancestor."""

    compounds: list[Compound]
    child: list[bool]
    weight: tuple[int, int, int]

    def meets(self, stack: list, name: str, attributes: dict[str, str]) -> bool:
        """Of an element about to be opened on a stack of nodes with name and attributes."""
        if not self.compounds[0].meets(name, attributes):
            return False
        k, at, back = 1, len(stack) - 1, None  # back: where the last ancestor search may go on
        while k < len(self.compounds):
            if at < 0:
                return False
            if self.compounds[k].meets(stack[at].name, stack[at].attributes):
                if not self.child[k - 1]:
                    back = (k, at - 1)
                k, at = k + 1, at - 1
            elif not self.child[k - 1]:
                at -= 1
            elif back:
                (k, at), back = back, None
            else:
                return False
        return True


def read_selector(text: str) -> Selector | None:
    """None if nothing at rest can match, or if the selector is not understood."""
    text, at, compounds, child = text.strip(), 0, [], []
    try:
        while True:
            c, at = _compound(text, at, 0)
            compounds.append(c)
            if at == len(text):
                break
            m = COMBINATOR.match(text, at)
            if m is None or (m[1] or " ") in "+~":
                return None
            child.append(m[1] == ">")
            at = m.end()
    except Unread:
        return None
    if any(c.never for c in compounds):
        return None
    weight = tuple(map(sum, zip(*(c.weight for c in compounds), strict=True)))
    return Selector(compounds[::-1], child[::-1], weight)  # type: ignore[arg-type]


def _length(text: str) -> float | None:
    m = re.fullmatch(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)\s*([a-z]*)\s*", text)
    return float(m[1]) * PIXELS[m[2]] if m and m[2] in PIXELS else None


def _ratio(text: str) -> float | None:
    a, _, b = text.partition("/")
    try:
        return float(a) / float(b or 1)
    except (ValueError, ZeroDivisionError):
        return None


def _resolution(text: str) -> float | None:
    m = re.fullmatch(r"\s*(\d+\.?\d*|\.\d+)\s*(dppx|dpi|dpcm|x)?\s*", text)
    return float(m[1]) / {"dpi": 96, "dpcm": 96 / 2.54}.get(m[2], 1) if m else None


MEASURES = {
    "width": (WIDTH, _length), "device-width": (WIDTH, _length), "inline-size": (WIDTH, _length), "height": (HEIGHT, _length), "device-height": (HEIGHT, _length),
    "aspect-ratio": (WIDTH / HEIGHT, _ratio), "device-aspect-ratio": (WIDTH / HEIGHT, _ratio), "resolution": (1.0, _resolution), "device-pixel-ratio": (1.0, _resolution),
    "color": (8, _ratio), "monochrome": (0, _ratio), "color-index": (0, _ratio),
}
TESTS = {"<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__, "=": float.__eq__}
TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}


def _feature(text: str) -> bool | None:
    """Whether a feature holds; None if it is not known."""
    text = text.strip()
    if m := re.fullmatch(r"(?:-webkit-|-moz-)?(min-|max-|min--moz-|max--moz-)?([a-z-]+)\s*:\s*(.+)", text, re.S):
        name, value = m[2], m[3].strip()
        if name in MEASURES:
            have, read = MEASURES[name]
            want = read(value)
            return None if want is None else TESTS[{"min": ">=", "max": "<="}.get((m[1] or "")[:3], "=")](float(have), want)
        return None if name not in FEATURES or m[1] else value in FEATURES[name]
    if "<" in text or ">" in text or "=" in text:
        parts = re.split(r"\s*(<=|>=|<|>|=)\s*", text)
        at = next((k for k in range(0, len(parts), 2) if parts[k].strip() in MEASURES), None)
        if at is None:
            return None
        have, read = MEASURES[parts[at].strip()]
        done = []
        for k in range(1, len(parts), 2):
            value = read(parts[k - 1] if k > at + 1 or k + 1 == at else parts[k + 1])
            if value is None:
                return None
            done.append(TESTS[parts[k] if k - 1 == at else TURNED[parts[k]]](float(have), value))
        return all(done)
    if text in PLAIN:
        return True
    return False if text in MEASURES or text in FEATURES else None


def _joined(words: list[str]) -> bool | None:
    """not, and, or over \x01T, \x01F and \x01U."""
    value: bool | None = None
    negate, sign, first = False, "and", True
    for w in words:
        if w in ("and", "or"):
            sign = w
        elif w == "not":
            negate = not negate
        else:
            one = {"\x01T": True, "\x01F": False}.get(w)
            one = (None if one is None else not one) if negate else one
            negate = False
            if first:
                value, first = one, False
            elif sign == "and":
                value = False if value is False or one is False else (None if value is None or one is None else True)
            else:
                value = True if value is True or one is True else (None if value is None or one is None else False)
    return value


def applies(query: str) -> bool:
    """Whether a media query list holds on the screen."""
    query = re.sub(r"/\*.*?\*/", " ", query.lower(), flags=re.S).strip()
    if not query:
        return True
    word = {True: " \x01T ", False: " \x01F ", None: " \x01U "}
    for one in split_at(query, ","):
        while True:
            new = re.sub(r"\(([^()]*)\)", lambda m: word[_joined(m[1].split()) if "\x01" in m[1] and ":" not in m[1] else _feature(m[1])], one)
            if new == one:
                break
            one = new
        words = [w for w in one.split() if w != "only"]
        words = [w if w in ("and", "or", "not") or w.startswith("\x01") else ("\x01T" if w in ("all", "screen") else "\x01F") for w in words]
        # "not" before a type negates the whole query
        whole = words[0:1] == ["not"] and len(one.split()) > 1 and not one.split()[1].startswith("\x01")
        value = _joined(words[1:] if whole else words)
        if (value is False) if whole else value:
            return True
    return False


@dataclass(frozen=True)
class Switch:
    """A declaration of display or visibility: 'none', 'hidden' or the like, and whether it is important."""

    prop: str
    value: str
    important: bool


def declarations(text: str) -> list[Switch]:
    out = []
    for part in split_at(text, ";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if colon and name in ("display", "visibility"):
            value = " ".join(value.lower().split())
            plain = re.sub(r" ?! ?important$", "", value)
            if (DISPLAY if name == "display" else VISIBILITY).fullmatch(plain):
                out.append(Switch(name, plain, plain != value))
    return out


class Cascade:
    """Rules of all stylesheets so far, by what their last compound asks for."""

    def __init__(self) -> None:
        self.rules: dict[str, list[tuple[tuple, Selector, Switch]]] = {}
        self.ranked: dict[str, dict[str, list[tuple[tuple, Selector, str]]]] = {}  # by key and property, the strongest first
        self.ranked_at = 0
        self.order = 0
        self.layers: dict[str, int] = {}

    def _add(self, selectors: list[str], body: str, layer: str | None) -> None:
        if not (found := declarations(body)):
            return
        for s in selectors:
            if (sel := read_selector(s)) is None:
                continue
            c = sel.compounds[0]
            key = f"#{c.ids[0]}" if c.ids else f".{c.kinds[0]}" if c.kinds else c.tag or "*"
            for d in found:
                self.order += 1
                # rules outside of layers beat those in them, the other way round if important
                rank = len(self.layers) + 1 if layer is None else self.layers[layer]
                strength = (d.important, (-rank if layer is not None else -1_000_000_000) if d.important else (rank if layer is not None else 1_000_000_000), False, sel.weight, self.order)
                self.rules.setdefault(key, []).append((strength, sel, d))

    def read(self, text: str) -> None:
        """A stylesheet. Unclosed blocks end with it."""
        if not re.search(r"display|visibility|@layer|\\\\", text, re.I):
            return
        # A block: (whether rules count, selectors of the style rule it is in, layer, its declarations so far)
        stack: list[tuple[bool, list[str] | None, str | None, list[str]]] = [(True, None, None, [])]
        part: list[str] = []
        depth = 0

        def ended() -> None:
            counts, selectors, layer, own = stack.pop()
            if counts and selectors:
                self._add(selectors, ";".join(own), layer)

        for m in TOKEN.finditer(text):
            t = m[0]
            if t.startswith("/*") or t in ("<!--", "-->"):
                continue
            if t in "([" and len(t) == 1:
                depth += 1
            elif t in ")]" and len(t) == 1:
                depth = max(0, depth - 1)
            if t == "{":
                depth = 0
                head, part = "".join(part).strip(), []
                counts, selectors, layer, own = stack[-1]
                if counts and selectors and own:  # what comes before a nested block loses to it
                    self._add(selectors, ";".join(own), layer)
                    own.clear()
                if head.startswith("@"):
                    name, rest = re.fullmatch(r"@([\w-]*)(.*)", head, re.S).groups()
                    name = name.lower()
                    if name == "media":
                        counts = counts and applies(rest)
                    elif name == "supports":
                        counts = counts and not rest.strip().lower().startswith("not")
                    elif name == "layer":
                        layer = (f"{layer}." if layer else "") + (rest.strip() or f"#{len(self.layers)}")
                        self.layers.setdefault(layer, len(self.layers))
                    else:
                        counts = False
                    stack.append((counts, selectors, layer, []))
                else:
                    inner = split_at(head, ",") if counts else []
                    if selectors is not None and counts:
                        inner = [s.replace("&", p) if "&" in s else f"{p} {s}" for s in inner for p in selectors] if len(inner) * len(selectors) <= NESTED else []
                    stack.append((counts, inner, layer, []))
            elif t == ";" and depth == 0:
                head, part = "".join(part).strip(), []
                if stack[-1][1] is not None:
                    stack[-1][3].append(head)
                elif head[:6].lower() == "@layer":
                    for name in head[6:].split(","):
                        self.layers.setdefault((f"{stack[-1][2]}." if stack[-1][2] else "") + name.strip(), len(self.layers))
            elif t == "}":
                depth = 0
                stack[-1][3].append("".join(part))
                part = []
                if len(stack) > 1:
                    ended()
            else:
                part.append(t)
        stack[-1][3].append("".join(part))
        while len(stack) > 1:
            ended()

    def _rank(self) -> None:
        self.ranked, self.ranked_at = {}, self.order
        for key, rules in self.rules.items():
            of = self.ranked.setdefault(key, {})
            for strength, sel, d in sorted(rules, key=lambda r: r[0], reverse=True):
                of.setdefault(d.prop, []).append((strength, sel, d.value))

    def switched(self, stack: list, name: str, attributes: dict[str, str]) -> dict[str, str]:
        """The winning values of display and visibility of an element about to be opened.

        Elements alike in name and attributes under one parent are judged once.
        """
        seen = stack[-1].judged
        like = (self.order, name, *attributes.items())
        if like not in seen:
            seen[like] = self._switched(stack, name, attributes)
        return seen[like]

    def _switched(self, stack: list, name: str, attributes: dict[str, str]) -> dict[str, str]:
        best: dict[str, tuple[tuple, str]] = {}
        if self.rules:
            if self.ranked_at != self.order:
                self._rank()
            keys = ["*", name, *(f".{c}" for c in set(attributes.get("class", "").split()))]
            if attributes.get("id"):
                keys.append(f"#{attributes['id']}")
            for key in keys:
                for prop, rules in self.ranked.get(key, {}).items():
                    for strength, sel, value in rules:
                        if prop in best and strength < best[prop][0]:
                            break
                        if sel.meets(stack, name, attributes):
                            best[prop] = (strength, value)
                            break
        if style := attributes.get("style"):
            for d in declarations(style):
                strength = (d.important, 2_000_000_000, True)
                if d.prop not in best or strength >= best[d.prop][0][:3]:
                    best[d.prop] = ((*strength, (0, 0, 0), 0), d.value)
        return {p: v for p, (_, v) in best.items()}
