"""Public licences: whole texts with their usual variants, and names for notices of one line."""

from __future__ import annotations

from pathlib import Path

from .licences import _WARRANTY, KNOWN

_ENDS = ("END OF TERMS AND CONDITIONS", "Exhibit A - Source Code Form License Notice", "EXHIBIT A -Mozilla Public License.", "ADDENDUM: How to use this License")
_ADDRESSES = (
    "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
    "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA",
)
_KEEP_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_KEEP_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY {0} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {1} BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_HOLDERS = [
    ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDER OR CONTRIBUTORS"),
    ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDERS OR CONTRIBUTORS"),
    ("THE REGENTS AND CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS"),
    ("THE AUTHOR AND CONTRIBUTORS", "THE AUTHOR OR CONTRIBUTORS"),
    ("THE AUTHOR", "THE AUTHOR"),
]
_NO_NAMES = [f"Neither the name of {who} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." for who in ("the copyright holder", "the University", "the author", "the organization", "the <organization>", "the project")]
_NO_NAMES.append("The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.")
_SHORT = [
    ("MIT-0", "MIT No Attribution", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so.\n\n" + _WARRANTY)),
    ("Zlib", "zlib License", (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is "
        "not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software.\n3. This notice may not be removed or altered from any source distribution.")),
    ("Unlicense", "The Unlicense", (
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial "
        "or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this "
        "software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the "
        "benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt "
        "act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
        + _WARRANTY.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "THE AUTHORS")
        + "\n\nFor more information, please refer to <https://unlicense.org/>")),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and '
        "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is "
        "furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, "
        "including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
        "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely "
        "in the form of machine-executable object code generated by a source language processor.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")),
]


def _texts() -> list[tuple[str, str, str]]:
    out = [r for r in KNOWN if r[1] == "text"]
    plain = [(n, *t.split("\n\n", 1)) for n, _, t in out] + [("MIT", "The MIT License (MIT)", t.split("\n\n", 1)[1]) for n, _, t in out if n == "MIT"]
    for name, title, text in plain + _SHORT:
        out += [(name, "text", text), (name, "text", f"{title}\n\n{text}")]
    for who in _HOLDERS:
        for a, b, c in (("1. ", "2. ", "3. "), ("", "", ""), ("(1) ", "(2) ", "(3) ")):
            head = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
            for name, titles, thirds in (("BSD-2-Clause", ("", "BSD 2-Clause License\n\n"), [""]), ("BSD-3-Clause", ("", "BSD 3-Clause License\n\n"), [c + t + "\n" for t in _NO_NAMES])):
                out += [(name, "text", f"{t}{head}{a}{_KEEP_SOURCE}\n{b}{_KEEP_BINARY}\n{third}\n{_BSD_WARRANTY.format(*who)}") for t in titles for third in thirds]
    for path in sorted(Path(__file__).with_name("licence_texts").glob("*.txt")):
        whole = path.read_text("utf-8")
        forms = [whole, *[whole[: whole.index(e)] for e in _ENDS if e in whole], *[whole[: whole.index(e) + len(e)] for e in _ENDS[:1] if e in whole]]
        for form in forms:
            out.append((path.stem, "text", form))
            lines = "\n".join(" ".join(x.split()) for x in form.split("\n"))
            out += [(path.stem, "text", lines.replace(old, new)) for old in _ADDRESSES if old in lines for new in _ADDRESSES if new != old]
    return out


_VERSIONED = [
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0", "Apache License v2.0", "Apache License (Version 2.0)"]),
    ("MIT", ["MIT License", "MIT", "MIT/X11 License", "Expat License"]),
    ("MIT-0", ["MIT-0", "MIT No Attribution License"]), ("ISC", ["ISC License", "ISC"]), ("0BSD", ["0BSD", "BSD Zero Clause License", "Zero-Clause BSD License"]),
    ("BSD-2-Clause", ["BSD-2-Clause", "BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"]),
    ("BSD-3-Clause", ["BSD-3-Clause", "BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License"]),
    ("Unlicense", ["Unlicense", "Unlicense License"]), ("Zlib", ["zlib License", "zlib"]), ("BSL-1.0", ["BSL-1.0", "Boost Software License 1.0", "Boost Software License, Version 1.0"]),
    ("CC0-1.0", ["CC0", "CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"]),
    ("Artistic-1.0-Perl", ["Artistic-1.0-Perl"]),
]
for _n in ("1.1", "2.0"):
    _VERSIONED.append((f"MPL-{_n}", [f.format(_n) for f in ("Mozilla Public License {}", "Mozilla Public License, Version {}", "Mozilla Public License, v. {}", "Mozilla Public License v{}", "MPL {}", "MPL-{}", "MPL v{}")]))
for _k, _long, _all in (("GPL", "GNU General Public License", ("1.0", "2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")), ("LGPL", "GNU Library General Public License", ("2.0",)), ("AGPL", "GNU Affero General Public License", ("3.0",)), ("GFDL", "GNU Free Documentation License", ("1.2", "1.3"))):
    for _v in _all:
        for _tail, _says in (("", [""]), ("-or-later", [" or later", " or any later version", " or (at your option) any later version"])):
            _names = [f.format(_long, _k, v) + s for v in {_v, _v.removesuffix(".0")} for s in _says for f in ("{0} {2}", "{0}, version {2}", "{0} v{2}", "{0} v. {2}", "{0} as published by the Free Software Foundation, version {2}", "{1} {2}", "{1} v{2}", "{1}v{2}", "{1}, version {2}", "GNU {1} {2}", "GNU {1} v{2}", "GNU {1}v{2}")]
            _ids = [f"{_k}-{_v}{_tail}", f"{_k}-{_v}" + ("+" if _tail else "-only")]
            _VERSIONED.append((f"{_k}-{_v}{_tail}", _names + [x for x in _ids if not x.endswith("+")]))
for _k, _long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _v, _port in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        _VERSIONED.append((f"CC-{_k}-{_v}", [f"CC {_k} {_v}", f"CC-{_k}-{_v} License", *[f"Creative Commons {_long} {_v}{p}{s}" for p in ("", " " + _port) for s in ("", " License")], f"CC {_k} {_v} {_port}"]))


def rows() -> list[tuple[str, str, str]]:
    """(licence, ``text`` or ``notice`` or ``name``, text)."""
    names = [(licence, "name", form) for licence, forms in _VERSIONED for n in forms for form in (n, n + " License")]
    return [r for r in KNOWN if r[1] == "notice"] + sorted(set(_texts())) + sorted(set(names))
