"""Ordered signature rules for license texts, notices, tags and mentions.

A line is: label, priority, confidence in hundredths, keyword, pattern; separated by ` ; `. Patterns see a text as lower-cased words with one space between
them, so a version reads `2 0`, and match whole words. The keyword is a run of whole words that every match holds. Priorities: 4 the text of a license, 3 a
notice that grants one, 2 a tag or an exact name, 1 a mention.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    no: int
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: str


TEXTS = """
mit ; 4 ; 100 ; permission is hereby granted free of charge ; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files( the software)? to deal in the software without restriction
mit ; 4 ; 95 ; and or sell copies of ; (to )?use copy modify merge publish distribute sublicense and or sell copies of the software
mit ; 4 ; 90 ; this permission notice shall be included ; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 ; 4 ; 90 ; without restriction including without limitation ; without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit-advertising ; 4 ; 90 ; permission notice shall be included ; permission notice shall be included in all copies of the software and its copyright notices in addition publicly documented acknowledgment
mit-modern ; 4 ; 85 ; permission is hereby granted without written ; permission is hereby granted without written agreement and without license or royalty fees
x11 ; 4 ; 90 ; except as contained in this notice ; except as contained in this notice the names? of ([^ ]+ ){1,12}shall not be used in advertising or otherwise to promote the sale
isc ; 4 ; 100 ; permission to use copy modify and ; permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted
0bsd ; 4 ; 95 ; permission to use copy modify and ; permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is
hpnd ; 4 ; 85 ; permission to use copy modify ; permission to use copy modify( and)? distribute( and sell)? this software and its documentation for any purpose
bsd ; 4 ; 95 ; redistribution and use in source and binary forms ; redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause ; 4 ; 95 ; may be used to endorse or promote ; neither the names? of ([^ ]+ ){1,12}may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause ; 4 ; 95 ; all advertising materials mentioning ; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause ; 4 ; 80 ; redistributions in binary form must ; redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided
bsd ; 4 ; 75 ; redistributions of source code must retain ; redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
warranty-disclaimer ; 4 ; 60 ; without warranty of any kind ; the software is provided as is without warranty of any kind( express or implied)?
warranty-disclaimer ; 4 ; 60 ; in no event shall ; in no event shall ([^ ]+ ){1,12}be liable for any (claim damages or other liability|direct indirect incidental special)
warranty-disclaimer ; 4 ; 55 ; implied warranties ; the implied warranties of merchantability( and)? fitness for a particular purpose
warranty-disclaimer ; 4 ; 55 ; without even the implied warranty ; without even the implied warranty of merchantability or fitness for a particular purpose
apache-2.0 ; 4 ; 100 ; terms and conditions for use reproduction ; terms and conditions for use reproduction and distribution
apache-2.0 ; 4 ; 95 ; grants to you a perpetual worldwide ; each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (copyright|patent) license
apache-2.0 ; 4 ; 90 ; unless required by applicable law ; unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-1.1 ; 4 ; 90 ; includes software developed by the apache ; this product includes software developed by the apache (software foundation|group)
gpl ; 4 ; 95 ; everyone is permitted to copy and distribute ; everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl-2.0 ; 4 ; 100 ; the licenses for most software are designed ; the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0 ; 4 ; 100 ; free copyleft license for software ; the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3.0 ; 4 ; 95 ; covered work ; you may not convey (a|the) covered work if you are a party to an arrangement
gpl ; 4 ; 90 ; terms and conditions for copying ; terms and conditions for copying distribution and modification
agpl-3.0 ; 4 ; 100 ; remote network interaction ; remote network interaction use with the gnu general public license
agpl-3.0 ; 4 ; 95 ; specifically designed to ensure cooperation ; specifically designed to ensure cooperation with the community in the case of network server software
lgpl-2.1 ; 4 ; 100 ; lesser general public license ; this license the lesser general public license applies to some specially designated software packages
lgpl-3.0 ; 4 ; 95 ; incorporates the terms and conditions ; this version of the gnu lesser general public license incorporates the terms and conditions of version 3
mpl-2.0 ; 4 ; 95 ; covered software ; covered software is provided under this license on an as is basis
mpl-2.0 ; 4 ; 90 ; incompatible with secondary licenses ; incompatible with secondary licenses
epl-2.0 ; 4 ; 95 ; the accompanying program is provided ; the accompanying program is provided under the terms of this eclipse public license
unlicense ; 4 ; 100 ; free and unencumbered software ; this is free and unencumbered software released into the public domain
wtfpl ; 4 ; 100 ; what the fuck you want to ; (do what the fuck you want to public license|you just do what the fuck you want to)
zlib ; 4 ; 100 ; altered source versions must be ; altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib ; 4 ; 90 ; the origin of this software must not ; the origin of this software must not be misrepresented
bsl-1.0 ; 4 ; 100 ; obtaining a copy of the software and accompanying ; permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
cc0-1.0 ; 4 ; 95 ; to the extent possible under law ; to the extent possible under law ([^ ]+ ){0,12}has waived all copyright and related or neighboring rights
cc ; 4 ; 85 ; by exercising the licensed rights ; by exercising the licensed rights defined below you accept and agree to be bound
ofl-1.1 ; 4 ; 95 ; reserved font name ; with reserved font name
artistic-2.0 ; 4 ; 95 ; the standard version ; you are permitted to use the standard version( of the package)? and create and use modified versions for any purpose
postgresql ; 4 ; 90 ; without a written agreement ; (permission to use copy modify and distribute this software and its documentation for any purpose )?without fee and without a written agreement( is hereby granted)?
beerware ; 4 ; 100 ; buy me a beer ; you can buy me a beer in return
json ; 4 ; 95 ; shall be used for good ; the software shall be used for good not evil
python-2.0 ; 4 ; 95 ; psf hereby grants licensee ; psf hereby grants licensee a nonexclusive royalty free world wide license
openssl ; 4 ; 95 ; includes software developed by the openssl ; this product includes software developed by the openssl project
"""

NOTICES = """
mit ; 3 ; 95 ; mit license ; (released|licensed|distributed|available|published|provided|made available) under (the )?(terms of )?(the )?mit license
mit ; 3 ; 90 ; mit license ; (use|uses|using|covered by|subject to|governed by) (of )?(this source code is governed by )?(the|an|a) mit license
mit ; 3 ; 90 ; the mit license ; the mit license mit
apache-2.0 ; 3 ; 100 ; apache license ; licensed under the apache license version 2 0( the license)?
apache-2.0 ; 3 ; 95 ; apache license ; (released|distributed|available|published|provided|made available|licensed) under (the )?(terms of )?(the )?apache license( version)? 2( 0)?
apache ; 3 ; 85 ; apache license ; (released|distributed|available|published|provided|made available|licensed) under (the )?(terms of )?(the )?apache license
apache-2.0 ; 3 ; 95 ; apache org licenses ; (http |https )?www apache org licenses license 2 0
gpl-2.0-or-later ; 3 ; 100 ; either version 2 ; gnu general public license as published by the free software foundation either version 2 of the license or( at your option)? any later version
gpl-3.0-or-later ; 3 ; 100 ; either version 3 ; gnu general public license as published by the free software foundation either version 3 of the license or( at your option)? any later version
lgpl-2.1-or-later ; 3 ; 100 ; either version 2 1 ; gnu lesser general public license as published by the free software foundation either version 2 1 of the license or( at your option)? any later version
lgpl-3.0-or-later ; 3 ; 100 ; lesser general public license ; gnu lesser general public license as published by the free software foundation either version 3 of the license or( at your option)? any later version
lgpl-2.0-or-later ; 3 ; 100 ; library general public license ; gnu library general public license as published by the free software foundation either version 2 of the license or( at your option)? any later version
agpl-3.0-or-later ; 3 ; 100 ; affero general public license ; gnu affero general public license as published by the free software foundation either version 3 of the license or( at your option)? any later version
gpl-2.0-only ; 3 ; 95 ; general public license ; gnu general public license version 2 as published by the free software foundation
gpl-2.0-only ; 3 ; 95 ; version 2 only ; (gpl|general public license) version 2 only
gpl-3.0-only ; 3 ; 95 ; version 3 only ; (gpl|general public license) version 3 only
gpl-2.0 ; 3 ; 90 ; general public license ; (under|by) the( terms of the)? (gnu )?general public license( gpl)? (version|v)( )?2( 0)?
gpl-3.0 ; 3 ; 90 ; general public license ; (under|by) the( terms of the)? (gnu )?general public license( gpl)? (version|v)( )?3( 0)?
gpl ; 3 ; 85 ; general public license ; (released|licensed|distributed|available|published|provided|made available|redistribute it and or modify it) under (the )?(terms of )?(the )?(gnu )?general public license
gpl ; 3 ; 80 ; gpl ; (released|licensed|distributed|available|published|provided|made available) under (the )?(terms of )?(the )?(gnu )?gpl
lgpl ; 3 ; 85 ; lesser general public license ; (released|licensed|distributed|available|published|provided|made available|redistribute it and or modify it) under (the )?(terms of )?(the )?(gnu )?lesser general public license
lgpl ; 3 ; 80 ; lgpl ; (released|licensed|distributed|available|published|provided|made available) under (the )?(terms of )?(the )?(gnu )?lgpl
agpl ; 3 ; 85 ; affero general public license ; (released|licensed|distributed|available|published|provided|made available) under (the )?(terms of )?(the )?(gnu )?affero general public license
agpl ; 3 ; 80 ; agpl ; (released|licensed|distributed|available|published|provided|made available) under (the )?(terms of )?(the )?(gnu )?agpl
gpl ; 3 ; 75 ; received a copy of the gnu ; you should have received a copy of the gnu general public license along with this (program|software|library|file)
lgpl ; 3 ; 75 ; received a copy of the gnu ; you should have received a copy of the gnu lesser general public license along with this (program|software|library|file)
gpl ; 3 ; 70 ; gnu org licenses ; (http |https )?(www )?gnu org licenses( gpl)?( 2 0| 3 0)?( html| txt)?
bsd ; 3 ; 85 ; bsd ; (released|licensed|distributed|available|published|provided|made available|governed) (under|by) (the |a )?(terms of )?(the )?bsd( style)? license
bsd-3-clause ; 3 ; 95 ; bsd ; (released|licensed|distributed|available|under) (under )?(the )?(3 clause|three clause|new|revised|modified) bsd license
bsd-2-clause ; 3 ; 95 ; bsd ; (released|licensed|distributed|available|under) (under )?(the )?(2 clause|two clause|simplified|freebsd) bsd license
mpl-2.0 ; 3 ; 100 ; mozilla public ; this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 ; 3 ; 95 ; mozilla public license version 1 1 ; subject to the mozilla public license version 1 1
mpl ; 3 ; 85 ; mozilla public license ; (released|licensed|distributed|available|published|provided|subject to|made available) (under )?(the )?(terms of )?(the )?mozilla public license
epl-1.0 ; 3 ; 95 ; eclipse public license ; (under|of) (the )?(terms of )?(the )?eclipse public license( version| v)? 1 0
epl-2.0 ; 3 ; 95 ; eclipse public license ; (under|of) (the )?(terms of )?(the )?eclipse public license( version| v)? 2 0
epl ; 3 ; 80 ; eclipse public license ; (released|licensed|distributed|available|published|provided|made available) under (the )?(terms of )?(the )?eclipse public license
eupl-1.2 ; 3 ; 95 ; european union public ; (under|of) (the )?(terms of )?(the )?european union public licen[cs]e( version| v)? 1 2
cddl-1.0 ; 3 ; 95 ; common development and distribution license ; (under|of|to) (the )?(terms of )?(the )?common development and distribution license
isc ; 3 ; 90 ; isc license ; (released|licensed|distributed|available|published|provided|made available) under (the )?(terms of )?(the )?isc license
zlib ; 3 ; 90 ; zlib ; (released|licensed|distributed|available|published|provided|made available) under (the )?(terms of )?(the )?zlib( libpng)? license
bsl-1.0 ; 3 ; 95 ; boost software license ; (released|licensed|distributed|available|published|provided|made available) under (the )?(terms of )?(the )?boost software license( version)? 1 0
unlicense ; 3 ; 90 ; unlicense ; (released|licensed|distributed|available|published|provided|made available|dedicated) (under|with|to) the unlicense
public-domain ; 3 ; 85 ; public domain ; (released|placed|dedicated|donated|put|is|are) (in|into|in to|to) the public domain
public-domain ; 3 ; 75 ; no copyright ; (no copyright (is claimed|reserved)|there is no copyright)
public-domain ; 3 ; 70 ; no rights reserved ; no rights reserved
cc-by-sa-4.0 ; 3 ; 100 ; creative commons ; under (a |the )?(terms of the )?creative commons attribution share( )?alike 4 0
cc-by-nc-sa-4.0 ; 3 ; 100 ; creative commons ; under (a |the )?(terms of the )?creative commons attribution non( )?commercial share( )?alike 4 0
cc-by-nc-nd-4.0 ; 3 ; 100 ; creative commons ; under (a |the )?(terms of the )?creative commons attribution non( )?commercial no( )?deriv(s|atives|ative works) 4 0
cc-by-nc-4.0 ; 3 ; 100 ; creative commons ; under (a |the )?(terms of the )?creative commons attribution non( )?commercial 4 0
cc-by-nd-4.0 ; 3 ; 100 ; creative commons ; under (a |the )?(terms of the )?creative commons attribution no( )?deriv(s|atives|ative works) 4 0
cc-by-4.0 ; 3 ; 100 ; creative commons ; under (a |the )?(terms of the )?creative commons attribution 4 0
cc-by-sa-3.0 ; 3 ; 100 ; creative commons ; under (a |the )?(terms of the )?creative commons attribution share( )?alike 3 0
cc-by-3.0 ; 3 ; 100 ; creative commons ; under (a |the )?(terms of the )?creative commons attribution 3 0
cc ; 3 ; 75 ; creative commons ; (released|licensed|distributed|available|published|provided|made available) under (a |the )?(terms of )?(a |the )?creative commons
cc-by ; 3 ; 95 ; creativecommons org licenses ; creativecommons org licenses by( 1 0| 2 0| 2 5| 3 0| 4 0)?
cc-by-sa ; 3 ; 95 ; creativecommons org licenses ; creativecommons org licenses by sa( 1 0| 2 0| 2 5| 3 0| 4 0)?
cc-by-nc ; 3 ; 95 ; creativecommons org licenses ; creativecommons org licenses by nc( 1 0| 2 0| 2 5| 3 0| 4 0)?
cc-by-nc-sa ; 3 ; 95 ; creativecommons org licenses ; creativecommons org licenses by nc sa( 1 0| 2 0| 2 5| 3 0| 4 0)?
cc-by-nd ; 3 ; 95 ; creativecommons org licenses ; creativecommons org licenses by nd( 1 0| 2 0| 2 5| 3 0| 4 0)?
cc0-1.0 ; 3 ; 95 ; creativecommons org publicdomain ; creativecommons org publicdomain zero( 1 0)?
gfdl ; 3 ; 95 ; free documentation license ; (under|of) (the )?(terms of )?(the )?gnu free documentation license
odbl-1.0 ; 3 ; 95 ; open database license ; (under|of) (the )?(terms of )?(the )?open database license
ofl-1.1 ; 3 ; 95 ; open font license ; (under|of) (the )?(terms of )?(the )?sil open font license
artistic ; 3 ; 85 ; artistic license ; (under|of) (the )?(terms of )?(the )?artistic license
perl ; 3 ; 85 ; same terms as perl ; (under )?the same terms as perl( itself)?
ms-pl ; 3 ; 90 ; microsoft public license ; (under|of) (the )?(terms of )?(the )?microsoft public license
sspl-1.0 ; 3 ; 95 ; server side public license ; (under|of) (the )?(terms of )?(the )?server side public license
busl-1.1 ; 3 ; 90 ; business source license ; (under|of) (the )?(terms of )?(the )?business source license
elastic-2.0 ; 3 ; 90 ; elastic license ; (under|of) (the )?(terms of )?(the )?elastic license
all-rights-reserved ; 3 ; 60 ; all rights reserved ; copyright( c)?( [0-9]{4})* ([^ ]+ ){0,10}all rights reserved
proprietary ; 3 ; 80 ; proprietary ; (proprietary and confidential|this software is proprietary|confidential and proprietary)
proprietary ; 3 ; 75 ; prior written ; (may not be|no part of this ([^ ]+ ){1,6}may be) (copied|reproduced|distributed|transmitted)( [^ ]+){0,6} without( the)?( express)? prior written (permission|consent)
non-commercial ; 3 ; 70 ; non commercial ; (for|to) (personal and )?non commercial (use|purposes)( only)?
dual-license ; 3 ; 70 ; licensed under ; (dual|double|tri|multi) licensed under
"""

TAGS = """
mit ; 2 ; 95 ; identifier mit ; spdx license identifier mit
apache-2.0 ; 2 ; 100 ; identifier apache ; spdx license identifier apache 2 0
gpl-2.0-only ; 2 ; 100 ; identifier gpl ; spdx license identifier gpl 2 0( only)?
gpl-2.0-or-later ; 2 ; 100 ; identifier gpl ; spdx license identifier gpl 2 0 or later
gpl-3.0-only ; 2 ; 100 ; identifier gpl ; spdx license identifier gpl 3 0( only)?
gpl-3.0-or-later ; 2 ; 100 ; identifier gpl ; spdx license identifier gpl 3 0 or later
lgpl-2.1-only ; 2 ; 100 ; identifier lgpl ; spdx license identifier lgpl 2 1( only)?
lgpl-2.1-or-later ; 2 ; 100 ; identifier lgpl ; spdx license identifier lgpl 2 1 or later
lgpl-3.0-only ; 2 ; 100 ; identifier lgpl ; spdx license identifier lgpl 3 0( only)?
lgpl-3.0-or-later ; 2 ; 100 ; identifier lgpl ; spdx license identifier lgpl 3 0 or later
agpl-3.0-only ; 2 ; 100 ; identifier agpl ; spdx license identifier agpl 3 0( only)?
agpl-3.0-or-later ; 2 ; 100 ; identifier agpl ; spdx license identifier agpl 3 0 or later
bsd-2-clause ; 2 ; 100 ; identifier bsd ; spdx license identifier bsd 2 clause
bsd-3-clause ; 2 ; 100 ; identifier bsd ; spdx license identifier bsd 3 clause
mpl-2.0 ; 2 ; 100 ; identifier mpl ; spdx license identifier mpl 2 0
epl-2.0 ; 2 ; 100 ; identifier epl ; spdx license identifier epl 2 0
isc ; 2 ; 100 ; identifier isc ; spdx license identifier isc
cc0-1.0 ; 2 ; 100 ; identifier cc0 ; spdx license identifier cc0 1 0
unlicense ; 2 ; 100 ; identifier unlicense ; spdx license identifier unlicense
zlib ; 2 ; 100 ; identifier zlib ; spdx license identifier zlib
bsl-1.0 ; 2 ; 100 ; identifier bsl ; spdx license identifier bsl 1 0
mit ; 2 ; 85 ; license mit ; license mit
apache-2.0 ; 2 ; 90 ; apache 2 ; (license|licence) apache 2( 0)?
gpl-2.0 ; 2 ; 85 ; license gpl ; license gpl v?2( 0)?
gpl-3.0 ; 2 ; 85 ; license gpl ; license gpl v?3( 0)?
bsd ; 2 ; 80 ; license bsd ; license bsd
mit ; 2 ; 80 ; mit expat license ; (the )?mit expat license
mit ; 2 ; 80 ; expat license ; (the )?expat license
x11 ; 2 ; 80 ; x11 license ; (the )?(mit )?x11 license
apache-2.0 ; 2 ; 85 ; apache license ; apache license( version| v)? 2( 0)?
apache-2.0 ; 2 ; 80 ; apache 2 ; apache 2 0( license)?
apache-1.1 ; 2 ; 85 ; apache license ; apache license( version| v)? 1 1
apache-1.0 ; 2 ; 85 ; apache license ; apache license( version| v)? 1 0
apache-1.1 ; 2 ; 80 ; apache software license ; apache software license( version)? 1 1
gpl-2.0 ; 2 ; 85 ; general public license ; (gnu )?general public license( gpl)?( version| v)( )?2( 0)?
gpl-3.0 ; 2 ; 85 ; general public license ; (gnu )?general public license( gpl)?( version| v)( )?3( 0)?
gpl-2.0 ; 2 ; 75 ; gpl ; (gnu )?gpl v?2( 0)?( license)?
gpl-3.0 ; 2 ; 75 ; gpl ; (gnu )?gpl v?3( 0)?( license)?
gpl-2.0 ; 2 ; 75 ; gplv2 ; gplv2( 0)?( license)?
gpl-3.0 ; 2 ; 75 ; gplv3 ; gplv3( 0)?( license)?
gpl-2.0-or-later ; 2 ; 85 ; or later ; gpl v?2( 0)? or later
gpl-3.0-or-later ; 2 ; 85 ; or later ; gpl v?3( 0)? or later
lgpl-2.1 ; 2 ; 85 ; lesser general public license ; (gnu )?lesser general public license( lgpl)?( version| v)? 2 1
lgpl-3.0 ; 2 ; 85 ; lesser general public license ; (gnu )?lesser general public license( lgpl)?( version| v)? 3( 0)?
lgpl-2.0 ; 2 ; 85 ; library general public license ; (gnu )?library general public license( lgpl)?( version| v)? 2( 0)?
lgpl-2.1 ; 2 ; 75 ; lgpl ; (gnu )?lgpl v?2 1( license)?
lgpl-3.0 ; 2 ; 75 ; lgpl ; (gnu )?lgpl v?3( 0)?( license)?
agpl-3.0 ; 2 ; 85 ; affero general public license ; (gnu )?affero general public license( agpl)?( version| v)? 3( 0)?
agpl-3.0 ; 2 ; 75 ; agpl ; (gnu )?agpl v?3( 0)?( license)?
lgpl-2.1 ; 2 ; 75 ; lgplv2 ; lgplv2( 1)?( license)?
lgpl-3.0 ; 2 ; 75 ; lgplv3 ; lgplv3( 0)?( license)?
agpl-3.0 ; 2 ; 75 ; agplv3 ; agplv3( 0)?( license)?
bsd-3-clause ; 2 ; 90 ; bsd ; (bsd 3 clause|3 clause bsd|three clause bsd|new bsd|revised bsd|modified bsd)( license)?
bsd-2-clause ; 2 ; 90 ; bsd ; (bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)( license)?
bsd-2-clause ; 2 ; 85 ; freebsd license ; freebsd license
bsd-4-clause ; 2 ; 90 ; bsd ; (bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)( license)?
0bsd ; 2 ; 90 ; bsd ; (bsd zero clause|zero clause bsd)( license)?
0bsd ; 2 ; 85 ; 0bsd ; 0bsd( license)?
mpl-2.0 ; 2 ; 85 ; mozilla public license ; mozilla public license( mpl)?( version| v)? 2( 0)?
mpl-1.1 ; 2 ; 85 ; mozilla public license ; mozilla public license( mpl)?( version| v)? 1 1
mpl-2.0 ; 2 ; 75 ; mpl ; mpl v?2( 0)?
epl-1.0 ; 2 ; 85 ; eclipse public license ; eclipse public license( epl)?( version| v)? 1 0
epl-2.0 ; 2 ; 85 ; eclipse public license ; eclipse public license( epl)?( version| v)? 2 0
eupl-1.1 ; 2 ; 80 ; eupl ; eupl v?1 1
eupl-1.2 ; 2 ; 80 ; eupl ; eupl v?1 2
cddl-1.0 ; 2 ; 80 ; cddl ; cddl( version| v)? 1 0
cddl-1.1 ; 2 ; 80 ; cddl ; cddl( version| v)? 1 1
cc-by-4.0 ; 2 ; 90 ; cc by ; cc by 4 0
cc-by-3.0 ; 2 ; 90 ; cc by ; cc by 3 0
cc-by-2.0 ; 2 ; 90 ; cc by ; cc by 2 (0|5)
cc-by-sa-4.0 ; 2 ; 90 ; cc by sa ; cc by sa 4 0
cc-by-sa-3.0 ; 2 ; 90 ; cc by sa ; cc by sa 3 0
cc-by-sa-2.0 ; 2 ; 90 ; cc by sa ; cc by sa 2 (0|5)
cc-by-nc-4.0 ; 2 ; 90 ; cc by nc ; cc by nc 4 0
cc-by-nc-3.0 ; 2 ; 90 ; cc by nc ; cc by nc 3 0
cc-by-nc-sa-4.0 ; 2 ; 90 ; cc by nc sa ; cc by nc sa 4 0
cc-by-nc-sa-3.0 ; 2 ; 90 ; cc by nc sa ; cc by nc sa 3 0
cc-by-nc-nd-4.0 ; 2 ; 90 ; cc by nc nd ; cc by nc nd 4 0
cc-by-nc-nd-3.0 ; 2 ; 90 ; cc by nc nd ; cc by nc nd 3 0
cc-by-nd-4.0 ; 2 ; 90 ; cc by nd ; cc by nd 4 0
cc-by-nd-3.0 ; 2 ; 90 ; cc by nd ; cc by nd 3 0
cc0-1.0 ; 2 ; 90 ; cc0 ; cc0( 1 0)?( universal)?( public domain dedication)?
cc0-1.0 ; 2 ; 90 ; creative commons zero ; creative commons zero( 1 0| v1 0)?
cc-by-sa ; 2 ; 80 ; creative commons ; creative commons attribution share( )?alike
cc-by-nc ; 2 ; 80 ; creative commons ; creative commons attribution non( )?commercial
cc-by-nc-sa ; 2 ; 80 ; creative commons ; creative commons attribution non( )?commercial share( )?alike
cc-by-nd ; 2 ; 80 ; creative commons ; creative commons attribution no( )?deriv(s|atives|ative works)
cc-by ; 2 ; 75 ; creative commons ; creative commons attribution
pddl-1.0 ; 2 ; 85 ; public domain dedication ; (open data commons )?public domain dedication and license
odc-by-1.0 ; 2 ; 85 ; open data commons ; open data commons attribution license
ogl-uk-3.0 ; 2 ; 85 ; open government licence ; open government licence( for public sector information)?( v| version)? 3( 0)?
artistic-1.0 ; 2 ; 85 ; artistic license ; artistic license( version| v)? 1( 0)?
artistic-2.0 ; 2 ; 85 ; artistic license ; artistic license( version| v)? 2( 0)?
php-3.0 ; 2 ; 85 ; php license ; php license( version| v)? 3 0?1?
python-2.0 ; 2 ; 85 ; python software foundation license ; python software foundation license( version)?( 2)?
ncsa ; 2 ; 85 ; ncsa ; (university of illinois )?ncsa open source license
afl-3.0 ; 2 ; 85 ; academic free license ; academic free license( version| v)? 3 0
osl-3.0 ; 2 ; 85 ; open software license ; open software license( version| v)? 3 0
cpl-1.0 ; 2 ; 85 ; common public license ; common public license( version| v)? 1 0
ipl-1.0 ; 2 ; 85 ; ibm public license ; ibm public license( version| v)? 1 0
lppl-1.3c ; 2 ; 85 ; latex project public license ; latex project public license( version| v)? 1 3c?
ms-rl ; 2 ; 85 ; microsoft reciprocal license ; microsoft reciprocal license
upl-1.0 ; 2 ; 85 ; universal permissive license ; universal permissive license( version| v)? 1 0
bsl-1.0 ; 2 ; 85 ; boost software license ; boost software license( version| v)? 1 0
openrail ; 2 ; 80 ; openrail ; (creativeml |bigscience |bigcode )?openrail( m| m1)?( license)?
llama-community ; 2 ; 80 ; community license agreement ; llama( [0-9])*( [0-9])? community license agreement
"""

MENTIONS = """
mit ; 1 ; 50 ; mit license ; mit license
apache ; 1 ; 50 ; apache license ; apache license
gpl ; 1 ; 50 ; general public license ; general public license
lgpl ; 1 ; 50 ; lesser general public license ; (gnu )?lesser general public license
lgpl ; 1 ; 50 ; library general public license ; (gnu )?library general public license
agpl ; 1 ; 50 ; affero general public license ; (gnu )?affero general public license
gpl ; 1 ; 40 ; gpl ; gpl
lgpl ; 1 ; 40 ; lgpl ; lgpl
agpl ; 1 ; 40 ; agpl ; agpl
bsd ; 1 ; 45 ; bsd ; bsd( style)? licen[cs]es?
mpl ; 1 ; 45 ; mozilla public license ; mozilla public license
epl ; 1 ; 45 ; eclipse public license ; eclipse public license
eupl ; 1 ; 45 ; european union public ; european union public licen[cs]e
cddl ; 1 ; 45 ; common development and distribution license ; common development and distribution license
isc ; 1 ; 45 ; isc license ; isc license
zlib ; 1 ; 45 ; zlib license ; zlib license
bsl ; 1 ; 45 ; boost software license ; boost software license
unlicense ; 1 ; 45 ; unlicense ; the unlicense
cc ; 1 ; 40 ; creative commons ; creative commons( licen[cs]e)?
cc-by ; 1 ; 40 ; cc by ; cc by
cc-by-sa ; 1 ; 45 ; cc by sa ; cc by sa
cc-by-nc ; 1 ; 45 ; cc by nc ; cc by nc
public-domain ; 1 ; 30 ; public domain ; public domain
gfdl ; 1 ; 45 ; free documentation license ; (gnu )?free documentation license
odbl ; 1 ; 45 ; open database license ; open database license
ofl ; 1 ; 45 ; open font license ; open font license
artistic ; 1 ; 40 ; artistic license ; artistic license
sspl ; 1 ; 45 ; server side public license ; server side public license
busl ; 1 ; 45 ; business source license ; business source license
all-rights-reserved ; 1 ; 20 ; all rights reserved ; all rights reserved
permissive ; 1 ; 30 ; permissive ; permissive (open source )?license
copyleft ; 1 ; 30 ; copyleft ; copyleft( license)?
eula ; 1 ; 40 ; end user license agreement ; end user license agreement
"""


def rules() -> list[Rule]:
    """All rules in order; the earlier of two that agree in place and priority stays."""
    out = []
    for line in "\n".join((TEXTS, NOTICES, TAGS, MENTIONS)).splitlines():
        if line:
            label, priority, confidence, keyword, pattern = line.split(" ; ", 4)
            out.append(Rule(len(out), label, int(priority), int(confidence) / 100, keyword, pattern))
    return out
