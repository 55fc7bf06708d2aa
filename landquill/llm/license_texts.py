"""Templates of the license scan: whole texts (folder ``licenses``) and the usual notices of the common licenses.

A template is (license, text). Words in braces tell the license from others that read alike: without them, side by side, nothing is
found.
The texts end with the terms; "how to apply" appendices are among the notices. Of Creative Commons, only CC0 is here as a whole text.
"""

from __future__ import annotations

from pathlib import Path

FOLDER = Path(__file__).with_name("licenses")

_GNU_HEADER = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the {names} License as published by the Free Software Foundation; "
    "either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {names} License for more details."
)
_GNU_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the {names} License version {version} as published by the Free Software Foundation."
_GNU_SHORT = ("Licensed under the {names} License, version {version}.", "This work is licensed under the {names} License, version {version}.", "Released under the {names} License v{version}.")
_GNU = (
    ("GPL-1.0", "{GNU General Public}", "{GPL}", "1", "{1}"),
    ("GPL-2.0", "{GNU General Public}", "{GPL}", "2", "{2}"),
    ("GPL-3.0", "{GNU General Public}", "{GPL}", "3", "{3}"),
    ("LGPL-2.0", "{GNU Library General Public}", "{LGPL}", "2", "{2}"),
    ("LGPL-2.1", "{GNU Lesser General Public}", "{LGPL}", "2.1", "{2.1}"),
    ("LGPL-3.0", "{GNU Lesser General Public}", "{LGPL}", "3", "{3}"),
    ("AGPL-3.0", "{GNU Affero General Public}", "{AGPL}", "3", "{3}"),
    ("GFDL-1.2", "{GNU Free Documentation}", "{GFDL}", "1.2", "{1.2}"),
    ("GFDL-1.3", "{GNU Free Documentation}", "{GFDL}", "1.3", "{1.3}"),
)
_NAMED = (
    ("MIT", "{MIT}"),
    ("ISC", "{ISC}"),
    ("Zlib", "{zlib}"),
    ("BSD", "{BSD}"),
    ("BSD-2-Clause", "{BSD 2-Clause}"),
    ("BSD-2-Clause", "{2-clause BSD}"),
    ("BSD-2-Clause", "{Simplified BSD}"),
    ("BSD-3-Clause", "{BSD 3-Clause}"),
    ("BSD-3-Clause", "{3-clause BSD}"),
    ("BSD-3-Clause", "{New BSD}"),
    ("BSD-3-Clause", "{Modified BSD}"),
    ("BSD-4-Clause", "{BSD 4-Clause}"),
    ("BSD-4-Clause", "{4-clause BSD}"),
)
_IDENTIFIERS = "MIT MIT-0 ISC Zlib Unlicense BSD-2-Clause BSD-3-Clause BSD-4-Clause Apache-2.0 MPL-1.1 MPL-2.0 GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 GFDL-1.2 GFDL-1.3 CC0-1.0 Artistic-1.0-Perl".split()
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def notices() -> list[tuple[str, str]]:
    out = [
        ("Apache-2.0", "Licensed under the {Apache} License, Version {2.0}."),
        ("Apache-2.0", "Released under the {Apache} License {2.0}."),
        (
            "Apache-2.0",
            'Licensed under the {Apache} License, Version {2.0} (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
            "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
            '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        ),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the {Mozilla Public} License, v. {2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the {Mozilla Public} License, v. {2.0}."),
        ("MPL-1.1", "The contents of this file are subject to the {Mozilla Public} License Version {1.1} (the \"License\"); you may not use this file except in compliance with the License."),
        ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under {CC0}."),
        ("CC0-1.0", "Released under {CC0 1.0} Universal."),
        ("Unlicense", "This is free and {unencumbered} software released into the public domain."),
        ("BSD", "Use of this source code is governed by a {BSD}-style license that can be found in the LICENSE file."),
        ("MIT", "Use of this source code is governed by an {MIT}-style license that can be found in the LICENSE file."),
    ]
    for name, words in _NAMED:
        out += [(name, f"Released under the {words} License."), (name, f"Licensed under the {words} License."), (name, f"This project is licensed under the terms of the {words} license.")]
    for version in ("1.1", "2.0"):
        out += [(f"MPL-{version}", f"Licensed under the {{Mozilla Public}} License, version {{{version}}}."), (f"MPL-{version}", f"Released under the {{MPL {version}}}.")]
    for name, names, short, version, mark in _GNU:
        out += [(name, text.format(names=names, version=mark)) for text in (_GNU_HEADER, _GNU_ONLY, *_GNU_SHORT)]
        out += [(name, f"Licensed under the {short} version {mark}."), (name, f"Released under the {short[:-1]} {version}}}.")]
    out += [(name, f"SPDX-License-Identifier: {{{name}}}") for name in _IDENTIFIERS]
    for kind, words in _CC.items():
        for version in _CC_VERSIONS:
            name = f"CC-{kind}-{version}"
            out += [
                (name, f"Licensed under {{CC {kind} {version}}}."),
                (name, f"This work is licensed under {{CC {kind} {version}}}."),
                (name, f"Licensed under the Creative Commons {{{words} {version}}} International License."),
                (name, f"This work is licensed under a Creative Commons {{{words} {version}}} International License."),
                (name, f"SPDX-License-Identifier: {{{name}}}"),
            ]
    return out


def library() -> list[tuple[str, str]]:
    """All whole texts and notices."""
    return [(p.stem, p.read_text()) for p in sorted(FOLDER.glob("*.txt"))] + notices()
