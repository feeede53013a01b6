"""Sentences of public licence texts and headers with their identifiers, and the rules over identifiers."""

from __future__ import annotations

# The sentences as they are published.
SENTENCES = (
    ("apache2", "Licensed under the Apache License, Version 2.0"),
    ("apache2", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("apache2", "This project is licensed under the Apache License 2.0"),
    ("apache2-only", "SPDX-License-Identifier: Apache-2.0"),
    ("apache-compliance", "you may not use this file except in compliance with the License."),
    ("apache-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-warranty", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache-see", "See the License for the specific language governing permissions and limitations under the License."),
    ("mit-name", "Released under the MIT license"),
    ("mit-name", "This project is licensed under the MIT license"),
    ("mit-name", "Licensed under the MIT License"),
    ("mit-name", "SPDX-License-Identifier: MIT"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("mit-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-name", "SPDX-License-Identifier: ISC"),
    ("isc-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("zero-bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-name", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-name", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-advert", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("bsd-warranty", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("bsd2-name", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd3-name", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd3-name", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("gpl3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl3", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl3-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl3-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl2", "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("gpl2-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl2-later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-details", "See the GNU General Public License for more details."),
    ("gpl-copy", "You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl21-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl21-later", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("lgpl3-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl3-later", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("lgpl-details", "See the GNU Lesser General Public License for more details."),
    ("agpl3-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl3-later", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("agpl-details", "See the GNU Affero General Public License for more details."),
    ("mpl2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl2", "SPDX-License-Identifier: MPL-2.0"),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl2", "SPDX-License-Identifier: EPL-2.0"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("boost", "SPDX-License-Identifier: BSL-1.0"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("zlib-origin", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "SPDX-License-Identifier: Unlicense"),
    ("unlicense-use", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc0", "SPDX-License-Identifier: CC0-1.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("reserved", "All rights reserved"),
)
# In order: a sequence of identifiers (`-`: unknown sentences) and the licence it stands for.
RULES = (
    (("apache-header", "apache-copy"), "Apache-2.0"),
    (("apache2", "apache-compliance", "apache-copy"), "Apache-2.0"),
    (("mit-grant", "mit-notice"), "MIT"),
    (("bsd-grant", "-", "bsd-source", "-", "bsd-binary", "-", "bsd-name"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-name"), "BSD-3-Clause"),
    (("bsd-grant", "-", "bsd-name"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-name"), "BSD-3-Clause"),
    (("bsd-grant", "-", "bsd-source", "-", "bsd-binary"), "BSD-2-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("bsd-grant",), "BSD-2-Clause"),
    (("bsd2-name",), "BSD-2-Clause"),
    (("bsd3-name",), "BSD-3-Clause"),
    (("isc-grant",), "ISC"),
    (("isc-name",), "ISC"),
    (("zero-bsd-grant",), "0BSD"),
    (("agpl3-later",), "AGPL-3.0-or-later"),
    (("lgpl3-later",), "LGPL-3.0-or-later"),
    (("lgpl21-later",), "LGPL-2.1-or-later"),
    (("gpl3-later",), "GPL-3.0-or-later"),
    (("gpl2-later",), "GPL-2.0-or-later"),
    (("apache-header",), "Apache-2.0"),
    (("apache2",), "Apache-2.0"),
    (("apache2-only",), "Apache-2.0"),
    (("mit-name",), "MIT"),
    (("mit-grant",), "MIT"),
    (("gpl3",), "GPL-3.0-only"),
    (("gpl2",), "GPL-2.0-only"),
    (("mpl2", "mpl2-copy"), "MPL-2.0"),
    (("mpl2",), "MPL-2.0"),
    (("epl2",), "EPL-2.0"),
    (("boost",), "BSL-1.0"),
    (("zlib-grant",), "Zlib"),
    (("unlicense",), "Unlicense"),
    (("cc0",), "CC0-1.0"),
    (("cc-by-nc-sa",), "CC-BY-NC-SA-4.0"),
    (("cc-by-nc",), "CC-BY-NC-4.0"),
    (("cc-by-nd",), "CC-BY-ND-4.0"),
    (("cc-by-sa",), "CC-BY-SA-4.0"),
    (("cc-by",), "CC-BY-4.0"),
    (("reserved",), "All-rights-reserved"),
)
