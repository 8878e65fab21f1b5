"""Configuration files: ordered sections of ordered, repeatable keys."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from treelake.functions.objects import TreelakeError

_SECTION = re.compile(r'\[\s*([A-Za-z0-9.-]+)(?:\s+"((?:[^"\\]|\\.)*)")?\s*\]')
_ESCAPES = {"n": "\n", "t": "\t", "b": "\b"}


def parse_value(s: str) -> str:
    """Quotes and escapes resolved, an unquoted comment and trailing white space dropped."""
    out, quoted, k = [], False, 0
    while k < len(s):
        c = s[k]
        if c == "\\" and k + 1 < len(s):
            out.append(_ESCAPES.get(s[k + 1], s[k + 1]))
            k += 1
        elif c == '"':
            quoted = not quoted
        elif c in "#;" and not quoted:
            break
        else:
            out.append(c)
        k += 1
    return "".join(out).rstrip()


@dataclass
class Config:
    sections: list[tuple[str, str | None, list[tuple[str, str]]]] = field(default_factory=list)

    @staticmethod
    def parse(text: str) -> Config:
        out = Config()
        for line in text.split("\n"):
            line = line.strip()
            if not line or line[0] in "#;":
                continue
            if line[0] == "[":
                m = _SECTION.fullmatch(line)
                if m is None:
                    raise TreelakeError("invalid_section_header", line=line)
                sub = m[2] if m[2] is None else m[2].replace("\\\\", "\\").replace('\\"', '"')
                out.sections.append((m[1].lower(), sub, []))
            elif not out.sections:
                raise TreelakeError("unexpected_line", line=line)
            else:
                key, eq, value = line.partition("=")
                out.sections[-1][2].append((key.strip(), parse_value(value.lstrip()) if eq else "true"))
        return out

    def get_all(self, section: str, key: str, subsection: str | None = None) -> list[str]:
        """Section and key without case, subsection exactly."""
        return [v for s, sub, pairs in self.sections if s == section.lower() and sub == subsection for k, v in pairs if k.lower() == key.lower()]

    def get(self, section: str, key: str, subsection: str | None = None) -> str | None:
        """The first value, in the first section that has the key."""
        return next(iter(self.get_all(section, key, subsection)), None)

    def add(self, section: str, key: str, value: str, subsection: str | None = None) -> None:
        for s, sub, pairs in self.sections:
            if s == section.lower() and sub == subsection:
                pairs.append((key, value))
                return
        self.sections.append((section.lower(), subsection, [(key, value)]))

    def set(self, section: str, key: str, value: str, subsection: str | None = None) -> None:
        for _, _, pairs in [x for x in self.sections if x[0] == section.lower() and x[1] == subsection]:
            pairs[:] = [p for p in pairs if p[0].lower() != key.lower()]
        self.add(section, key, value, subsection)

    def encode(self) -> str:
        out = []
        for s, sub, pairs in self.sections:
            out.append(f"[{s}]" if sub is None else '[%s "%s"]' % (s, sub.replace("\\", "\\\\").replace('"', '\\"')))
            for k, v in pairs:
                if re.search(r'["\\\n\t#;]', v) or v[:1] == " " or v[-1:] == " ":
                    v = '"%s"' % v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t")
                out.append(f"\t{k} = {v}")
        return "".join([line + "\n" for line in out])
