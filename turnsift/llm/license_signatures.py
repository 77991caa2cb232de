"""Hand-written signatures of single licenses: SPDX identifiers, short grants, header and body sentences.

Patterns are over lower-cased words joined by single spaces.  Every signature has a sample that it must find; the tests try all.
"""

from __future__ import annotations

#: Label and identifiers as the SPDX list writes them; "-only", "-or-later" and "+" may follow any of them.
SPDX = [
    ("0bsd", "0BSD"), ("afl-3", "AFL-3.0 AFL-2.1 AFL-2.0 AFL-1.2 AFL-1.1"), ("agpl-1", "AGPL-1.0"), ("agpl-3", "AGPL-3.0"),
    ("apache-1", "Apache-1.0"), ("apache-1.1", "Apache-1.1"), ("apache-2", "Apache-2.0"), ("apsl-2", "APSL-2.0"),
    ("artistic", "Artistic-1.0 Artistic-1.0-Perl Artistic-1.0-cl8"), ("artistic-2", "Artistic-2.0"), ("beerware", "Beerware"),
    ("blueoak-1", "BlueOak-1.0.0"), ("bsd-1", "BSD-1-Clause"), ("bsd-2", "BSD-2-Clause BSD-2-Clause-Views"),
    ("bsd-2-patent", "BSD-2-Clause-Patent"), ("bsd-3", "BSD-3-Clause BSD-3-Clause-LBNL"), ("bsd-3-clear", "BSD-3-Clause-Clear"),
    ("bsd-4", "BSD-4-Clause BSD-4-Clause-UC"), ("bsl-1", "BSL-1.0"), ("busl", "BUSL-1.1"), ("bzip2", "bzip2-1.0.6"),
    ("cal-1", "CAL-1.0"), ("cc-by", "CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0"),
    ("cc-by-nc", "CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-2.5 CC-BY-NC-3.0 CC-BY-NC-4.0"),
    ("cc-by-nc-nd", "CC-BY-NC-ND-2.0 CC-BY-NC-ND-2.5 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0"),
    ("cc-by-nc-sa", "CC-BY-NC-SA-2.0 CC-BY-NC-SA-2.5 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0"),
    ("cc-by-nd", "CC-BY-ND-2.0 CC-BY-ND-2.5 CC-BY-ND-3.0 CC-BY-ND-4.0"),
    ("cc-by-sa", "CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0"), ("cc0", "CC0-1.0"),
    ("cddl", "CDDL-1.0 CDDL-1.1"), ("cdla-permissive", "CDLA-Permissive-1.0 CDLA-Permissive-2.0"),
    ("cdla-sharing", "CDLA-Sharing-1.0"), ("cecill", "CECILL-2.0 CECILL-2.1"), ("cecill-b", "CECILL-B"), ("cecill-c", "CECILL-C"),
    ("cern-ohl-p", "CERN-OHL-P-2.0"), ("cern-ohl-s", "CERN-OHL-S-2.0"), ("cern-ohl-w", "CERN-OHL-W-2.0"), ("cpal-1", "CPAL-1.0"),
    ("cpl-1", "CPL-1.0"), ("curl", "curl"), ("ecl-2", "ECL-2.0"), ("efl-2", "EFL-2.0"), ("epl-1", "EPL-1.0"), ("epl-2", "EPL-2.0"),
    ("eupl", "EUPL-1.0 EUPL-1.1 EUPL-1.2"), ("ftl", "FTL"), ("gfdl", "GFDL-1.1 GFDL-1.2 GFDL-1.3"), ("gpl-1", "GPL-1.0"),
    ("gpl-2", "GPL-2.0"), ("gpl-3", "GPL-3.0"), ("hpnd", "HPND"), ("icu", "ICU"), ("ijg", "IJG"), ("intel", "Intel"), ("ipl-1", "IPL-1.0"),
    ("isc", "ISC"), ("jasper", "JasPer-2.0"), ("json", "JSON"), ("lgpl-2", "LGPL-2.0"), ("lgpl-2.1", "LGPL-2.1"),
    ("lgpl-3", "LGPL-3.0"), ("libpng", "Libpng libpng-2.0"), ("lppl", "LPPL-1.2 LPPL-1.3a LPPL-1.3c"), ("mit", "MIT X11"),
    ("mit-0", "MIT-0"), ("mit-cmu", "MIT-CMU"), ("mpl-1", "MPL-1.0"), ("mpl-1.1", "MPL-1.1"),
    ("mpl-2", "MPL-2.0 MPL-2.0-no-copyleft-exception"), ("ms-pl", "MS-PL"), ("ms-rl", "MS-RL"), ("mulanpsl-2", "MulanPSL-2.0"),
    ("ncsa", "NCSA"), ("npl", "NPL-1.0 NPL-1.1"), ("odbl", "ODbL-1.0"), ("odc-by", "ODC-By-1.0"), ("ofl", "OFL-1.0 OFL-1.1"),
    ("openldap", "OLDAP-2.8"), ("openssl", "OpenSSL"), ("osl-3", "OSL-3.0 OSL-2.1"), ("parity", "Parity-7.0.0"), ("pddl", "PDDL-1.0"),
    ("php", "PHP-3.0 PHP-3.01"), ("polyform-nc", "PolyForm-Noncommercial-1.0.0"), ("postgresql", "PostgreSQL"),
    ("psf", "PSF-2.0 Python-2.0 Python-2.0.1"), ("qpl-1", "QPL-1.0"), ("rpl", "RPL-1.1 RPL-1.5"), ("ruby", "Ruby"), ("sleepycat", "Sleepycat"),
    ("spl-1", "SPL-1.0"), ("sspl", "SSPL-1.0"), ("tcl", "TCL"), ("unicode", "Unicode-DFS-2016 Unicode-3.0"), ("unlicense", "Unlicense"),
    ("upl-1", "UPL-1.0"), ("vim", "Vim"), ("w3c", "W3C"), ("wtfpl", "WTFPL"), ("zlib", "Zlib zlib-acknowledgement"), ("zpl", "ZPL-2.0 ZPL-2.1"),
]

#: Label, pattern, keywords, weight, sample.  Earlier signatures are stronger.
SIGNATURES = [
    # Body and header sentences.
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright", 0.9, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish", "to deal in", 0.9, "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish"),
    ("apache-2", r"you may obtain a copy of the license at (?:https? )?www apache org licenses license 2 0", "you may obtain", 1.0, "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", r"you may not use this file except in compliance with the license", "you may not use", 0.7, "you may not use this file except in compliance with the License."),
    ("apache-2", r"apache org licenses license 2 0", "apache org", 0.9, "https://www.apache.org/licenses/LICENSE-2.0.html"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "this product includes", 0.7, "This product includes software developed by the Apache Software Foundation"),
    ("bsd-4", r"all advertising materials mentioning features or use of this software must display", "all advertising", 0.95, "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-3", r"neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products", "neither the name", 0.95, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions of", 0.8, "Redistributions of source code must retain the above copyright notice, this list of conditions"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in", 0.8, "Redistributions in binary form must reproduce the above copyright notice"),
    ("isc", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "permission to use", 0.9, "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "this software is", 0.9, "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented", "altered source", 0.95, "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("bsl-1", r"boost org license 1 0 txt", "boost org", 1.0, "See http://www.boost.org/LICENSE_1_0.txt"),
    ("bsl-1", r"to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software", "to use reproduce", 0.95, "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "this is free", 1.0, "This is free and unencumbered software released into the public domain."),
    ("wtfpl", r"you just do what the fuck you want to", "you just do", 0.9, "0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer", "if we meet", 1.0, "If we meet some day, and you think this stuff is worth it, you can buy me a beer in return."),
    ("json", r"the software shall be used for good not evil", "the software shall", 1.0, "The Software shall be used for Good, not Evil."),
    ("gpl-2", r"either version 2 of the license or at your option any later version", "either version", 0.8, "either version 2 of the License, or (at your option) any later version."),
    ("gpl-3", r"either version 3 of the license or at your option any later version", "either version", 0.8, "either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1", r"either version 2 1 of the license or at your option any later version", "either version", 0.9, "either version 2.1 of the License, or (at your option) any later version."),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document", "everyone is permitted", 0.7, "Everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", r"you should have received a copy of the gnu general public license along with this program", "you should have", 0.9, "You should have received a copy of the GNU General Public License along with this program"),
    ("agpl-3", r"you should have received a copy of the gnu affero general public license along with this program", "you should have", 1.0, "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this", "you should have", 0.9, "You should have received a copy of the GNU Lesser General Public License along with this library"),
    ("gpl", r"gnu org licenses gpl(?: html| txt)?", "gnu org", 0.8, "https://www.gnu.org/licenses/gpl.html"),
    ("gpl-3", r"gnu org licenses gpl 3 0", "gnu org", 0.9, "http://www.gnu.org/licenses/gpl-3.0.txt"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license v 2 0", "this source code", 1.0, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2", r"mozilla org mpl 2 0", "mozilla org", 0.9, "You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", "the contents of", 1.0, "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("epl-2", r"eclipse org legal epl 2 0", "eclipse org", 1.0, "https://www.eclipse.org/legal/epl-2.0/"),
    ("epl-1", r"eclipse org legal epl v10", "eclipse org", 1.0, "http://www.eclipse.org/legal/epl-v10.html"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", "this program and", 0.9, "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", "the contents of", 1.0, "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", "the person who", 1.0, "The person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", r"creativecommons org publicdomain zero", "creativecommons org", 1.0, "https://creativecommons.org/publicdomain/zero/1.0/"),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd", "creativecommons org", 1.0, "http://creativecommons.org/licenses/by-nc-nd/4.0/"),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa", "creativecommons org", 1.0, "http://creativecommons.org/licenses/by-nc-sa/4.0/"),
    ("cc-by-nc", r"creativecommons org licenses by nc", "creativecommons org", 1.0, "http://creativecommons.org/licenses/by-nc/3.0/"),
    ("cc-by-nd", r"creativecommons org licenses by nd", "creativecommons org", 1.0, "http://creativecommons.org/licenses/by-nd/4.0/"),
    ("cc-by-sa", r"creativecommons org licenses by sa", "creativecommons org", 1.0, "https://creativecommons.org/licenses/by-sa/3.0/"),
    ("cc-by", r"creativecommons org licenses by", "creativecommons org", 1.0, "https://creativecommons.org/licenses/by/4.0/"),
    ("ofl", r"this font software is licensed under the sil open font license", "this font software", 1.0, "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "permission is granted", 1.0, "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("openssl", r"this product includes software developed by the openssl project", "this product includes", 0.9, "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit"),
    ("php", r"this product includes php (?:software )?freely available from", "this product includes", 0.9, "This product includes PHP software, freely available from <http://www.php.net/software/>"),
    ("php", r"this source file is subject to version 3 0?1? of the php license", "this source file", 1.0, "This source file is subject to version 3.01 of the PHP license"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", "permission to use", 1.0, "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("psf", r"this license agreement is between the python software foundation", "this license agreement", 1.0, "This LICENSE AGREEMENT is between the Python Software Foundation (PSF)"),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim", "there are no", 1.0, "There are no restrictions on distributing unmodified copies of Vim"),
    ("ncsa", r"to deal with the software without restriction", "to deal with", 0.9, "to deal with the Software without restriction"),
    ("hpnd", r"permission to use copy modify distribute and sell this software and its documentation for any purpose", "permission to use", 0.9, "Permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose"),
    ("upl-1", r"the universal permissive license", "the universal", 0.9, "Licensed under the Universal Permissive License v 1.0"),
    ("artistic", r"you may make and give away verbatim copies of the source form of the standard version of this package", "you may make", 0.9, "You may make and give away verbatim copies of the source form of the Standard Version of this Package"),
    ("artistic-2", r"perlfoundation org artistic license 2 0", "perlfoundation org", 1.0, "http://www.perlfoundation.org/artistic_license_2_0"),
    ("perl", r"under the same terms as perl(?: 5)?(?: itself)?", "under the same", 0.9, "modify it under the same terms as Perl itself"),
    ("mit", r"opensource org licenses mit", "opensource org", 0.95, "https://opensource.org/licenses/MIT"),
    ("isc", r"opensource org licenses isc", "opensource org", 0.95, "https://opensource.org/licenses/ISC"),
    ("bsd-2", r"opensource org licenses bsd 2 clause", "opensource org", 0.95, "https://opensource.org/licenses/BSD-2-Clause"),
    ("bsd-3", r"opensource org licenses bsd 3 clause", "opensource org", 0.95, "https://opensource.org/licenses/BSD-3-Clause"),
    # Short grants with the bare name.
    ("mit-0", r"licensed under (?:the )?mit 0", "licensed under", 0.9, "Licensed under MIT-0"),
    ("mit", r"(?:dual |double )?(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:mit x11|x11|mit)", "licensed under,released under,distributed under,available under,published under,provided under", 0.9, "This project is licensed under MIT."),
    ("mit", r"mit licensed", "mit licensed", 0.8, "All code is MIT-licensed."),
    ("mit", r"licen[cs]e mit(?= (?:author|authors|private|dependencies|devdependencies|copyright|c|version|repository|scripts|main|or|and)\b|$)", "license mit,licence mit", 0.7, '"license": "MIT", "private": true'),
    ("isc", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?isc", "licensed under,released under,distributed under,available under,published under", 0.9, "Released under the ISC."),
    ("isc", r"isc licensed|licen[cs]e isc", "isc licensed,license isc,licence isc", 0.7, '"license": "ISC"'),
    ("zlib", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?zlib(?: libpng)?", "licensed under,released under,distributed under,available under", 0.9, "It is licensed under zlib."),
    ("unlicense", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?unlicen[cs]e", "licensed under,released under,distributed under,available under", 0.9, "Released under Unlicense"),
    ("bsl-1", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:boost(?: licen[cs]e)?|bsl 1 0)", "licensed under,released under,distributed under,available under", 0.9, "Distributed under BSL-1.0"),
    ("artistic-2", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?artistic 2(?: 0)?", "licensed under,released under,distributed under,available under", 0.9, "available under Artistic 2.0"),
    ("apache-1.1", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache 1 1", "licensed under,released under,distributed under,available under", 0.9, "licensed under Apache 1.1"),
    ("apache", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache(?! [12])", "licensed under,released under,distributed under,available under", 0.7, "licensed under Apache"),
    ("apache-2", r"asl ?2 0|al2 0", "asl,al2", 0.6, "License: ASL 2.0"),
    ("postgresql", r"licensed under (?:the )?(?:terms of (?:the )?)?postgresql", "licensed under", 0.9, "licensed under PostgreSQL"),
    ("openssl", r"licensed under (?:the )?(?:terms of (?:the )?)?openssl", "licensed under", 0.9, "licensed under OpenSSL"),
    ("curl", r"licensed under (?:the )?(?:terms of (?:the )?)?curl", "licensed under", 0.9, "licensed under curl"),
    ("vim", r"licensed under (?:the )?(?:terms of (?:the )?)?vim", "licensed under", 0.9, "Licensed under Vim"),
    ("ruby", r"licensed under (?:the )?(?:terms of (?:the )?)?ruby(?! on rails)(?: s)?", "licensed under", 0.9, "Licensed under Ruby's"),
    ("php", r"licensed under (?:the )?(?:terms of (?:the )?)?php(?: 3(?: 0?1)?)?", "licensed under", 0.9, "licensed under PHP 3.01"),
    ("psf", r"licensed under (?:the )?(?:terms of (?:the )?)?(?:psf|python software foundation)", "licensed under", 0.9, "Licensed under PSF"),
    ("cpl-1", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?cpl(?: 1 0)?", "licensed under,released under,distributed under,available under", 0.9, "released under CPL 1.0"),
    ("bsd-2", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?bsd 2", "licensed under,released under,distributed under,available under", 0.9, "released under BSD 2"),
    ("bsd-3", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?bsd 3", "licensed under,released under,distributed under,available under", 0.9, "released under BSD 3"),
    ("bsd", r"(?:licensed|released|distributed|available) under (?:the |a )?(?:terms of (?:the )?)?bsd", "licensed under,released under,distributed under,available under", 0.9, "released under BSD"),
    ("bsd", r"bsd licensed", "bsd licensed", 0.8, "a BSD-licensed kernel"),
    ("gpl", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl", "licensed under,released under,distributed under,available under", 0.9, "released under the GPL"),
    ("gpl", r"gpl(?: ?v ?[23])? licensed|gpled", "gpl,gpled", 0.8, "a GPL-licensed driver"),
    ("lgpl", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl", "licensed under,released under,distributed under,available under", 0.9, "released under the LGPL"),
    ("agpl", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?agpl", "licensed under,released under,distributed under,available under", 0.9, "released under the AGPL"),
    ("mpl", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mpl(?! [12])", "licensed under,released under,distributed under,available under", 0.9, "released under the MPL"),
    ("eupl", r"licensed under the eupl", "licensed under", 0.9, "Licensed under the EUPL"),
    ("cc-by", r"(?:licensed|released|distributed|available) under (?:a |the )?creative commons(?! zero| attribution)", "licensed under,released under,distributed under,available under", 0.6, "licensed under a Creative Commons licence"),
    # Names of licenses that have no entry among the names.
    ("afl-3", r"academic free licen[cs]e", "academic free", 0.6, "Academic Free License version 3.0"),
    ("osl-3", r"open software licen[cs]e(?: (?:version |v ?)?3 0)?", "open software", 0.6, "Open Software License 3.0"),
    ("lppl", r"latex project public licen[cs]e", "latex project", 0.6, "the LaTeX Project Public License"),
    ("ncsa", r"(?:university of illinois )?ncsa (?:open source )?licen[cs]e", "university of,ncsa", 0.6, "University of Illinois/NCSA Open Source License"),
    ("zpl", r"zope public licen[cs]e", "zope public", 0.6, "Zope Public License"),
    ("qpl-1", r"q public licen[cs]e", "q public", 0.6, "the Q Public License"),
    ("ecl-2", r"educational community licen[cs]e", "educational community", 0.6, "Educational Community License"),
    ("cecill", r"cecill(?: [bc])? (?:free software )?licen[cs]e", "cecill", 0.6, "the CeCILL license"),
    ("w3c", r"w3c software (?:notice and )?licen[cs]e", "w3c software", 0.6, "W3C Software Notice and License"),
    ("unicode", r"unicode licen[cs]e agreement", "unicode license,unicode licence", 0.6, "Unicode License Agreement"),
    ("pddl", r"public domain dedication and licen[cs]e", "public domain", 0.6, "Public Domain Dedication and License"),
    ("odc-by", r"open data commons attribution licen[cs]e", "open data", 0.6, "Open Data Commons Attribution License"),
    ("cdla-permissive", r"community data licen[cs]e agreement permissive", "community data", 0.6, "Community Data License Agreement - Permissive"),
    ("cdla-sharing", r"community data licen[cs]e agreement sharing", "community data", 0.6, "Community Data License Agreement - Sharing"),
    ("blueoak-1", r"blue oak model licen[cs]e", "blue oak", 0.6, "Blue Oak Model License 1.0.0"),
    ("mulanpsl-2", r"mulan permissive software licen[cs]e|mulan psl v2", "mulan", 0.6, "Mulan PSL v2"),
    ("polyform-nc", r"polyform noncommercial licen[cs]e", "polyform noncommercial", 0.6, "PolyForm Noncommercial License"),
    ("beerware", r"beer ?ware licen[cs]e", "beerware,beer ware", 0.6, "THE BEER-WARE LICENSE"),
    ("elastic-2", r"elastic licen[cs]e(?: 2 0)?", "elastic licen", 0.6, "Elastic License 2.0"),
    ("llama", r"llama ?[0-9]* (?:[0-9] )?community licen[cs]e", "llama", 0.6, "Llama 3.1 Community License"),
    ("sleepycat", r"sleepycat licen[cs]e", "sleepycat", 0.6, "Sleepycat License"),
    ("ftl", r"freetype (?:project )?licen[cs]e", "freetype", 0.6, "The FreeType Project LICENSE"),
    ("ijg", r"independent jpeg group s (?:software|licen[cs]e)", "independent jpeg", 0.6, "based in part on the work of the Independent JPEG Group's software"),
]
