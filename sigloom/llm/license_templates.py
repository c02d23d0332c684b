"""Wordings of common licenses and of their notices, as templates (see license_scan), by label.

[[...]] may be left out, {{a-b}} stands for a to b words of any kind; everything else is mandatory.
"""

_AS_IS = 'the software is provided "as is"'

_MIT_GRANT = (
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files [[(the \"software\")]], to deal in the software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, "
    "subject to the following conditions: "
)
_MIT_WARRANTY = (
    _AS_IS + ", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. "
    "in no event shall the {{1-8}} be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"
)

_BSD_TERMS = (
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "[[1]] [[a]] redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "[[2]] [[b]] redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "[[3]] [[c]] neither the [[name]] [[names]] of {{1-12}} nor the names of {{1-4}} contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_WARRANTY = (
    'this software is provided by {{1-10}} "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. '
    "in no event shall {{1-10}} be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; "
    "loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) "
    "arising in any way out of the use of this software, even if advised of the possibility of such damage"
)

_ISC_GRANT = "permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    ' [[the]] [[this]] software is provided "as is" and {{1-8}} [[disclaims]] [[disclaim]] all warranties with regard to this software including all implied warranties of merchantability and fitness. '
    "in no event shall {{1-8}} be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, "
    "whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software"
)

_UNDER = "licensed under [[the terms of]] [[a]] [[the]] "
_GNU_FREE = "is free software you can redistribute it and/or modify it under the terms of the gnu {kind} as published by the free software foundation; "
_GNU_LATER = "[[either]] version {version} of the license[[, or [[(at your option)]] any later version]]"

#: The notices of the GNU licenses by label: name in the notice, version, and the name in short.
_GNU = {
    "GPL-2.0": ("general public license", "2[[.0]]", "gpl"), "GPL-3.0": ("general public license", "3[[.0]]", "gpl"),
    "LGPL-2.1": ("lesser general public license", "2.1", "lgpl"), "LGPL-3.0": ("lesser general public license", "3[[.0]]", "lgpl"), "AGPL-3.0": ("affero general public license", "3[[.0]]", "agpl"),
}

#: Creative Commons licenses by label: short name and long name; all are of version 4.0.
_CC = {
    "CC-BY-4.0": ("by", "attribution"), "CC-BY-SA-4.0": ("by-sa", "attribution-sharealike"), "CC-BY-NC-4.0": ("by-nc", "attribution-noncommercial"),
    "CC-BY-ND-4.0": ("by-nd", "attribution-noderivatives"), "CC-BY-NC-SA-4.0": ("by-nc-sa", "attribution-noncommercial-sharealike"), "CC-BY-NC-ND-4.0": ("by-nc-nd", "attribution-noncommercial-noderivatives"),
}

#: SPDX identifiers and their labels, where these differ.
_SPDX = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "ISC": "ISC", "0BSD": "0BSD", "MPL-2.0": "MPL-2.0", "Unlicense": "Unlicense", "CC0-1.0": "CC0-1.0",
    "GPL-2.0": "GPL-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0": "GPL-3.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0",
    "LGPL-2.1": "LGPL-2.1", "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0",
    "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0",
}

#: Label -> templates.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "[[released]] [[licensed]] [[distributed]] under [[the terms of]] the mit license",
        _MIT_GRANT + "the above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the software. " + _MIT_WARRANTY,
    ],
    "MIT-0": [_MIT_GRANT.replace(", subject to the following conditions: ", ". ") + _MIT_WARRANTY],
    "ISC": [_ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_WARRANTY],
    "0BSD": [_ISC_GRANT + "." + _ISC_WARRANTY],
    "BSD-2-Clause": [_BSD_TERMS + _BSD_WARRANTY],
    "BSD-3-Clause": [_BSD_TERMS + _BSD_NAMES + _BSD_WARRANTY],
    "Apache-2.0": [
        _UNDER + "apache license[[, {{0-1}} version]] 2.0",
        'licensed under the apache license, version 2.0 [[(the "license")]]; you may not use this file except in compliance with the license. you may obtain a copy of the license at [[http]] [[https]] www.apache.org/licenses/license-2.0[[.txt]] '
        'unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied. '
        "see the license for the specific language governing permissions and limitations under the license",
    ],
    "MPL-2.0": [
        "this source code form is subject to the terms of the mozilla public license, [[v]] [[version]] 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at [[http]] [[https]] [[www.]]mozilla.org/mpl/2.0/",
        _UNDER + "mozilla public license [[v]] [[version]] 2.0",
    ],
    "Unlicense": [
        "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means",
    ],
    "CC0-1.0": [_UNDER + "cc0 1.0 [[universal]]", "[[released]] [[dedicated]] [[licensed]] under [[a]] [[the]] creative commons [[cc0]] [[zero]] 1.0 universal"],
}
for _label, (_kind, _version, _short) in _GNU.items():
    TEMPLATES[_label] = [
        _UNDER + f"gnu {_kind} [[version]] {_version} [[or [[(at your option)]] any later version]]",
        _UNDER + f"gnu {_kind} v{_version} [[or [[(at your option)]] any later version]]",
        _UNDER + f"[[gnu]] {_short} [[version]] {_version} [[or [[(at your option)]] any later version]]",
        _UNDER + f"[[gnu]] {_short}v{_version} [[or [[(at your option)]] any later version]]",
        _GNU_FREE.format(kind=_kind) + _GNU_LATER.format(version=_version),
    ]
for _label, (_short, _long) in _CC.items():
    TEMPLATES[_label] = [_UNDER + f"[[creative commons]] cc {_short} 4.0", _UNDER + f"creative commons {_long} 4.0 [[international]] [[public]] [[license]]"]
for _id, _label in _SPDX.items():
    TEMPLATES.setdefault(_label, []).append(f"spdx-license-identifier: {_id.lower()}")
