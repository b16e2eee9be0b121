"""The fixed table of licence texts and one-line notices.

Long texts lie in ``licence_texts`` as Debian ships them. A text or notice that does not tell whether later
versions may be used has the identifier ending in -only, as its SPDX tag would without an addition; a deprecated
tag keeps its own identifier. ``GPL``, ``LGPL`` and ``AGPL`` stand for lines that name no version.
"""

from __future__ import annotations

import re
from pathlib import Path

_FOLDER = Path(__file__).with_name("licence_texts")
_FILES = {
    "Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-1.0-only": "GPL-1", "GPL-2.0-only": "GPL-2", "GPL-3.0-only": "GPL-3", "LGPL-2.0-only": "LGPL-2", "LGPL-2.1-only": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3",
    "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "GFDL-1.2-only": "GFDL-1.2", "GFDL-1.3-only": "GFDL-1.3",
}
_END = re.compile(r"END OF TERMS AND CONDITIONS")
#: The foundation's addresses over the years, as texts in circulation have them.
_ADDRESS = re.compile(r"51 Franklin St(?:reet)?, Fifth Floor, Boston,\s+MA\s+02110-1301,?\s+USA")
_ADDRESSES = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA")


def _variants(text: str) -> list[str]:
    """The text as it is and up to the end of its terms, with filled-in names and earlier addresses."""
    out = [text, re.sub(r"(?m)^.*Copyright \[yyyy\].*$", "", text)]
    out += [_ADDRESS.sub(a, text) for a in _ADDRESSES]
    for t in list(out):
        m = _END.search(t)
        if m:
            out += [t[: m.end()], t[: m.start()]]
    return list(dict.fromkeys(out))


_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
{0} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{1} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = "{2} Neither the name of {name} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """THIS SOFTWARE IS PROVIDED BY {whose} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {liable} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MARKS = (("1.", "2.", "3."), ("*", "*", "*"))
_OWNERS = (("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDER OR CONTRIBUTORS"), ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT OWNER OR CONTRIBUTORS"), ("THE REGENTS AND CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS"), ("THE AUTHOR AND CONTRIBUTORS", "THE AUTHOR OR CONTRIBUTORS"), ("THE AUTHOR", "THE AUTHOR"))
_NAMES = ("the copyright holder", "the copyright holders", "the author", "the University", "the organization", "the project")


def _bsd() -> list[tuple[str, str]]:
    out = []
    for marks in _MARKS:
        for whose, liable in _OWNERS:
            end = _BSD_END.format(whose=whose, liable=liable)
            out += [("BSD-2-Clause", f"{t}{_BSD_HEAD.format(*marks)}{end}") for t in ("", "BSD 2-Clause License\n", "The 2-Clause BSD License\n")]
            out += [("BSD-3-Clause", f"{t}{_BSD_HEAD.format(*marks)}{_BSD_NAME.format(*marks, name=name)}{end}") for name in _NAMES for t in ("", "BSD 3-Clause License\n", "The 3-Clause BSD License\n")]
    return out


_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MORE = "For more information, please refer to <{}>"


def _unlicense() -> list[tuple[str, str]]:
    tails = ("", *(_MORE.format(a) for a in ("http://unlicense.org", "http://unlicense.org/")))
    return [("Unlicense", f"{t}{_UNLICENSE}\n\n{tail}") for t in ("", "The Unlicense\n", "Unlicense\n") for tail in tails]


TEXTS = [(k, t) for k, f in _FILES.items() for t in _variants((_FOLDER / f"{f}.txt").read_text("utf-8"))] + _bsd() + _unlicense()

_TAGS = """MIT ISC Apache-2.0 BSD-2-Clause BSD-3-Clause 0BSD Zlib BSL-1.0 Unlicense CC0-1.0 CC-BY-3.0 CC-BY-SA-3.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-ND-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0
GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later
GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later""".split()

_CALLED = {
    "MIT": ["MIT License", "MIT"], "ISC": ["ISC License"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"], "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"], "Unlicense": ["Unlicense"], "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal License"], "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "MPL 2.0"],
}
for _short, _long in (("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"), ("AGPL", "GNU Affero General Public License")):
    for _v in {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}[_short]:
        _id, _full = f"{_short}-{_v if '.' in _v else _v + '.0'}", _v if "." in _v else f"{_v}.0"
        _base = [f"{_long}{c} version {_v}" for c in ("", ",")] + [f"{_long} v{_v}", f"{_short}v{_v}", f"GNU {_short}v{_v}"] + ([f"{_long} v{_full}"] if _full != _v else [])
        _CALLED[f"{_id}-only"] = _base
        _CALLED[f"{_id}-or-later"] = [f"{b} or{x}" for b in _base for x in (" later", " any later version", " (at your option) any later version")]
for _k, _w in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items():
    _CALLED[f"CC-{_k}-4.0"] = [f"CC {_k} 4.0", f"Creative Commons {_w} 4.0 International License", f"Creative Commons {_w} 4.0 License"]

_SAID = [f"{how} under {the}{{}}" for how in ("Licensed", "Released", "Distributed", "Available", *(f"This {what} is {how}" for what in ("work", "project", "software", "program", "library", "code", "file", "package") for how in ("licensed", "released", "distributed"))) for the in ("", "the ", "a ")]
_SAID += ["License: {}"]

_FREE = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
_LONG = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}

#: Lines of standard file headers, and headers on one line.
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("MPL-2.0", "License, v. 2.0. If a copy of the MPL was not distributed with this"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    *((k, f"it under the terms of the {n} as published by") for k, n in _LONG.items()),
    *((f"GPL-{v}.0-only", f"it under the terms of the {_LONG['GPL']} version {v} as") for v in (2, 3)),
    *((f"{k}-{v if '.' in v else v + '.0'}-or-later", _FREE.format(what, ":", n, ",", v)) for k, n in _LONG.items() for what in ("program", "library", "software", "file") for v in {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}[k]),
]

NOTICES = [(t, f"SPDX-License-Identifier: {t}") for t in _TAGS] + HEADERS
NOTICES += [(k, said.format(n)) for k, names in _CALLED.items() for n in names for said in _SAID if "licen" in said.format(n).lower()]
