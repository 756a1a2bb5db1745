"""Licence templates: notices, title lines, SPDX tags, usual headers, and full texts (the .txt files beside this one)."""

from __future__ import annotations

from pathlib import Path

HERE = Path(__file__).parent
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    AS_IS + ", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
)
BSD2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
BSD3 = (
    *BSD2[:3],
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.",
    BSD2[3],
)
APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
)
REMOTE = (
    "Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, "
    "your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such "
    "interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server "
    "at no charge, through some standard or customary means of facilitating copying of software."
)


def text(name: str) -> str:
    return (HERE / f"{name}.txt").read_text("utf-8", "replace")


def gnu(kind: str, short: str, version: str, thing: str = "program") -> list[str]:
    """Notices, title and the paragraphs of the usual header of a GNU licence."""
    full, number = f"GNU {kind}General Public License", version.removesuffix(".0")
    grant = (
        f"is free software: you can redistribute it and/or modify it under the terms of the {full} as published by the Free Software Foundation, "
        f"either version {number} of the License, or (at your option) any later version."
    )
    warranty = (
        f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        f"or FITNESS FOR A PARTICULAR PURPOSE. See the {full} for more details."
    )
    copy = f"You should have received a copy of the {full} along with this {thing}. If not, see https://www.gnu.org/licenses/"
    return [
        f"This work is licensed under the {full}, version {number}",
        f"This work is licensed under the GNU {kind}GPL, version {number}",
        f"{full} version {number}",
        f"{short} v{number}",
        f"This {thing} {grant}",
        f"{grant} {warranty} {copy}",
        f"SPDX-License-Identifier: {short}-{version}",
        f"SPDX-License-Identifier: {short}-{version}-only",
        f"SPDX-License-Identifier: {short}-{version}-or-later",
    ]


def common(name: str, *notices: str) -> list[str]:
    return [*notices, f"SPDX-License-Identifier: {name}"]


def creative(kinds: str, words: str, version: str = "4.0") -> list[str]:
    scope = "International" if version == "4.0" else "Unported"
    return common(
        f"CC-{kinds}-{version}",
        f"This work is licensed under the Creative Commons {words} {version} {scope} License",
        f"This work is licensed under a Creative Commons {words} {version} {scope} License. To view a copy of this license, visit "
        f"https://creativecommons.org/licenses/{kinds.lower()}/{version}/",
        f"Creative Commons {words} {version} {scope}",
        f"Licensed under CC {kinds} {version}",
        f"CC {kinds} {version}",
    )


def short(name: str, spoken: str) -> list[str]:
    return common(name, f"Released under the {spoken} License", f"Licensed under the {spoken} License", f"{spoken} License", f"The {spoken} License")


CC = {
    "BY": "Attribution",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
}
#: For each licence its notices, header paragraphs and full texts
TEMPLATES = {
    "AGPL-3.0": [*gnu("Affero ", "AGPL", "3.0"), f"GNU Affero {REMOTE} {text('GPL-3.0')}"],
    "Apache-2.0": [
        *common("Apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License Version 2.0"),
        *APACHE, " ".join(APACHE), text("Apache-2.0"),
    ],
    "BSD-2-Clause": [*short("BSD-2-Clause", "BSD 2-Clause"), *short("BSD-2-Clause", "Simplified BSD"), *BSD2, " ".join(BSD2)],
    "BSD-3-Clause": [
        *short("BSD-3-Clause", "BSD 3-Clause"), *short("BSD-3-Clause", "BSD"),
        "Redistribution and use in source and binary forms are permitted under the BSD License", *BSD3, " ".join(BSD3), text("BSD-3-Clause"),
    ],
    **{f"CC-{k}-{v}": creative(k, w, v) for k, w in CC.items() for v in ("3.0", "4.0")},
    "CC0-1.0": [
        *common("CC0-1.0", "Licensed under CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal Public Domain Dedication"), text("CC0-1.0"),
    ],
    **{f"GPL-{v}": [*gnu("", "GPL", v), text(f"GPL-{v}")] for v in ("1.0", "2.0", "3.0")},
    "ISC": [*short("ISC", "ISC"), *ISC, " ".join(ISC)],
    "LGPL-2.0": [*gnu("Library ", "LGPL", "2.0", "library"), text("LGPL-2.0")],
    "LGPL-2.1": [*gnu("Lesser ", "LGPL", "2.1", "library"), text("LGPL-2.1")],
    "LGPL-3.0": [*gnu("Lesser ", "LGPL", "3.0"), *gnu("Lesser ", "LGPL", "3.0", "library"), text("LGPL-3.0")],
    "MIT": [*short("MIT", "MIT"), *MIT, " ".join(MIT)],
    **{
        f"MPL-{v}": [
            *common(f"MPL-{v}", f"This source code is subject to the terms of the Mozilla Public License, v. {v}", f"Mozilla Public License Version {v}"),
            f"This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}. If a copy of the MPL was not distributed with this file, "
            f"You can obtain one at https://mozilla.org/MPL/{v}/.",
            text(f"MPL-{v}"),
        ]
        for v in ("1.1", "2.0")
    },
}
