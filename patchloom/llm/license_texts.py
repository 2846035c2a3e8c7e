"""Public licence texts, standard headers, titles and one-line notices (fixed values)."""

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program."


def _gnu(what: str, name: str, version: str) -> list[str]:
    """The header of a GNU licence with and without later versions: its first paragraph, and all of it."""
    later = f"{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    only = f"{what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; version {version} of the License."
    return [later, only, f"{later} {_GNU_END.format(name=name)}"]


def _spdx(*names: str) -> list[str]:
    return [f"SPDX-License-Identifier: {n}" for n in names]


def _work(name: str) -> list[str]:
    return [f"This work is licensed under a Creative Commons {name} International License.", f"Creative Commons {name} International Public License"]


_OF = {
    "agpl-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", *_gnu("This program", "Affero General Public License", "3"), *_spdx("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later")],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        *_spdx("Apache-2.0"),
    ],
    "bsd-2-clause": ["Released under the BSD 2-Clause License.", "BSD 2-Clause License", " ".join((_BSD_HEAD, "1.", _BSD_1, "2.", _BSD_2, _BSD_END)), " ".join((_BSD_HEAD, _BSD_1, _BSD_2)), *_spdx("BSD-2-Clause")],
    "bsd-3-clause": [
        "Released under the BSD 3-Clause License.",
        "BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        " ".join((_BSD_HEAD, "1.", _BSD_1, "2.", _BSD_2, "3.", _BSD_3, _BSD_END)),
        " ".join((_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3)),
        *_spdx("BSD-3-Clause"),
    ],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "Boost Software License - Version 1.0 - August 17th, 2003", *_spdx("BSL-1.0")],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", *_work("Attribution 4.0"), *_spdx("CC-BY-4.0")],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", *_work("Attribution-NonCommercial 4.0"), *_spdx("CC-BY-NC-4.0")],
    "cc-by-nc-nd-4.0": ["Licensed under CC BY-NC-ND 4.0.", *_work("Attribution-NonCommercial-NoDerivatives 4.0"), *_spdx("CC-BY-NC-ND-4.0")],
    "cc-by-nc-sa-4.0": ["Licensed under CC BY-NC-SA 4.0.", *_work("Attribution-NonCommercial-ShareAlike 4.0"), *_spdx("CC-BY-NC-SA-4.0")],
    "cc-by-nd-4.0": ["Licensed under CC BY-ND 4.0.", *_work("Attribution-NoDerivatives 4.0"), *_spdx("CC-BY-ND-4.0")],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", *_work("Attribution-ShareAlike 4.0"), *_spdx("CC-BY-SA-4.0")],
    "cc0-1.0": ["To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication", *_spdx("CC0-1.0")],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", *_gnu("This program", "General Public License", "2"), *_spdx("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later")],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_gnu("This program", "General Public License", "3"), *_spdx("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later")],
    "isc": [
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        *_spdx("ISC"),
    ],
    "lgpl-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", *_gnu("This library", "Lesser General Public License", "2.1"), *_spdx("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later")],
    "lgpl-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_gnu("This library", "Lesser General Public License", "3"), *_spdx("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later")],
    "mit": [
        "MIT License",
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
        *_spdx("MIT"),
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", *_spdx("MPL-2.0")],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        *_spdx("Unlicense"),
    ],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", *_spdx("Zlib")],
}

#: (licence, text), by licence.
TEMPLATES = tuple((name, text) for name, texts in _OF.items() for text in texts)
