"""The signature rules of the license scan (operator 10), written by hand.

A text is scanned in folded form: lower-case words with one space between them. A line of RULES is
`order confidence label: regex`; lines stand under the keyword, in brackets, that a text must hold before they run. Orders
are 0 for identifiers, 1 for whole notices, 2 for grants, 3 for names with versions, 4 for names, 5 for weak hints; of
equal intervals the lower order wins, then the line that stands first.
"""

from __future__ import annotations

import re

#: The rules.
RULES = r"""
[spdx]
0 1.0 mit: spdx licen[sc]e identifier mit
0 1.0 mit-0: spdx licen[sc]e identifier mit 0
0 1.0 apache-2.0: spdx licen[sc]e identifier apache 2 0
0 1.0 apache-1.1: spdx licen[sc]e identifier apache 1 1
0 1.0 gpl-2.0: spdx licen[sc]e identifier gpl 2 0(?: only)?
0 1.0 gpl-2.0-or-later: spdx licen[sc]e identifier gpl 2 0 or later
0 1.0 gpl-3.0: spdx licen[sc]e identifier gpl 3 0(?: only)?
0 1.0 gpl-3.0-or-later: spdx licen[sc]e identifier gpl 3 0 or later
0 1.0 lgpl-2.1: spdx licen[sc]e identifier lgpl 2 1(?: only)?
0 1.0 lgpl-2.1-or-later: spdx licen[sc]e identifier lgpl 2 1 or later
0 1.0 lgpl-3.0: spdx licen[sc]e identifier lgpl 3 0(?: only)?
0 1.0 lgpl-3.0-or-later: spdx licen[sc]e identifier lgpl 3 0 or later
0 1.0 agpl-3.0: spdx licen[sc]e identifier agpl 3 0(?: only)?
0 1.0 agpl-3.0-or-later: spdx licen[sc]e identifier agpl 3 0 or later
0 1.0 bsd-2-clause: spdx licen[sc]e identifier bsd 2 clause
0 1.0 bsd-3-clause: spdx licen[sc]e identifier bsd 3 clause
0 1.0 0bsd: spdx licen[sc]e identifier 0bsd
0 1.0 isc: spdx licen[sc]e identifier isc
0 1.0 mpl-2.0: spdx licen[sc]e identifier mpl 2 0
0 1.0 epl-2.0: spdx licen[sc]e identifier epl 2 0
0 1.0 cc0-1.0: spdx licen[sc]e identifier cc0 1 0
0 1.0 cc-by-4.0: spdx licen[sc]e identifier cc by 4 0
0 1.0 cc-by-sa-4.0: spdx licen[sc]e identifier cc by sa 4 0
0 1.0 unlicense: spdx licen[sc]e identifier unlicense
0 1.0 zlib: spdx licen[sc]e identifier zlib
0 1.0 bsl-1.0: spdx licen[sc]e identifier bsl 1 0
0 0.9 other: spdx licen[sc]e identifier \S+(?: [0-9]+)*

[permission is hereby granted]
1 0.98 mit: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
1 0.95 bsl-1.0: permission is hereby granted free of charge to any person or organization obtaining a copy of the software
1 0.9 mit: permission is hereby granted free of charge
1 0.9 ofl-1.1: permission is hereby granted free of charge to any person obtaining a copy of the font software

[permission to use copy]
1 0.97 isc: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?: provided that)?
1 0.9 hpnd: permission to use copy modify and distribute this software and its documentation for any purpose

[redistribution and use]
1 0.95 bsd: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
1 0.8 bsd: redistribution and use in source and binary forms

[neither the name]
1 0.9 bsd-3-clause: neither the name of (?:\S+ ){1,12}?nor the names of its contributors may be used to endorse

[all advertising materials]
1 0.9 bsd-4-clause: all advertising materials mentioning features or use of this software must display

[altered source versions]
1 0.95 zlib: altered source versions must be plainly marked as such

[free and unencumbered]
1 0.98 unlicense: this is free and unencumbered software released into the public domain

[general public]
1 0.97 gpl-2.0-or-later: gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version
1 0.97 gpl-3.0-or-later: gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
1 0.95 gpl-2.0: gnu general public licen[sc]e version 2 as published by the free software foundation
1 0.95 gpl-3.0: gnu general public licen[sc]e version 3 as published by the free software foundation
2 0.97 gpl-3.0: (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public licen[sc]e v(?:ersion )?3(?: 0)?
2 0.97 gpl-2.0: (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public licen[sc]e v(?:ersion )?2(?: 0)?
2 0.94 gpl: (?:licen[sc]ed|released|distributed|available|covered|published) (?:under|by) (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e
3 0.92 gpl-3.0: (?:gnu )?general public licen[sc]e (?:version |v )?3(?: 0)?
3 0.92 gpl-3.0: (?:gnu )?general public licen[sc]e v3(?: 0)?
3 0.92 gpl-2.0: (?:gnu )?general public licen[sc]e (?:version |v )?2(?: 0)?
3 0.92 gpl-2.0: (?:gnu )?general public licen[sc]e v2(?: 0)?
3 0.9 gpl-1.0: (?:gnu )?general public licen[sc]e (?:version |v )?1(?: 0)?
4 0.8 gpl: gnu general public licen[sc]e
4 0.6 gpl: general public licen[sc]e

[gpl]
2 0.95 gpl-3.0: (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:gnu )?gpl ?v?3(?: 0)?
2 0.95 gpl-2.0: (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:gnu )?gpl ?v?2(?: 0)?
2 0.9 gpl: (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:gnu )?gpl
3 0.9 gpl-3.0-or-later: (?:gnu )?gpl ?v?3(?: 0)? or later
3 0.9 gpl-2.0-or-later: (?:gnu )?gpl ?v?2(?: 0)? or later
3 0.88 gpl-3.0: (?:gnu )?gpl ?v?3(?: 0)?
3 0.88 gpl-2.0: (?:gnu )?gpl ?v?2(?: 0)?
4 0.7 gpl: gnu gpl
5 0.5 gpl: gpl

[lesser]
1 0.97 lgpl-2.1-or-later: gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or at your option any later version
1 0.97 lgpl-3.0-or-later: gnu lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
2 0.94 lgpl: (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lesser general public licen[sc]e
3 0.92 lgpl-2.1: (?:gnu )?lesser general public licen[sc]e (?:version |v )?v?2 1
3 0.92 lgpl-3.0: (?:gnu )?lesser general public licen[sc]e (?:version |v )?v?3(?: 0)?
4 0.82 lgpl: (?:gnu )?lesser general public licen[sc]e

[library general]
3 0.92 lgpl-2.0: (?:gnu )?library general public licen[sc]e (?:version |v )?v?2(?: 0)?
4 0.82 lgpl-2.0: (?:gnu )?library general public licen[sc]e

[lgpl]
3 0.9 lgpl-2.1: (?:gnu )?lgpl ?v?2 1
3 0.9 lgpl-3.0: (?:gnu )?lgpl ?v?3(?: 0)?
4 0.7 lgpl: (?:gnu )?lgpl

[affero]
1 0.97 agpl-3.0-or-later: gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
3 0.92 agpl-3.0: (?:gnu )?affero general public licen[sc]e (?:version |v )?v?3(?: 0)?
3 0.9 agpl-1.0: (?:gnu )?affero general public licen[sc]e (?:version |v )?v?1(?: 0)?
4 0.82 agpl: (?:gnu )?affero general public licen[sc]e

[agpl]
3 0.9 agpl-3.0: (?:gnu )?agpl ?v?3(?: 0)?
4 0.7 agpl: (?:gnu )?agpl

[free documentation]
3 0.92 gfdl-1.3: (?:gnu )?free documentation licen[sc]e (?:version |v )?1 3
3 0.92 gfdl-1.2: (?:gnu )?free documentation licen[sc]e (?:version |v )?1 2
3 0.92 gfdl-1.1: (?:gnu )?free documentation licen[sc]e (?:version |v )?1 1
4 0.82 gfdl: (?:gnu )?free documentation licen[sc]e

[apache]
1 0.98 apache-2.0: licen[sc]ed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e
2 0.98 apache-2.0: (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licen[sc]e (?:version |v )?v?2(?: 0)?
2 0.94 apache: (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licen[sc]e
3 0.92 apache-2.0: apache(?: software)? licen[sc]e (?:version |v )?v?2(?: 0)?
3 0.92 apache-1.1: apache(?: software)? licen[sc]e (?:version |v )?v?1 1
3 0.92 apache-1.0: apache(?: software)? licen[sc]e (?:version |v )?v?1 0
3 0.85 apache-2.0: apache 2 0 licen[sc]ed?
4 0.8 apache: apache(?: software)? licen[sc]ed?

[ mit ]
2 0.95 mit: (?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:an? )?mit(?: x11| expat)? licen[sc]e
4 0.8 mit: (?:the )?mit licen[sc]e
4 0.75 mit: mit licen[sc]ed

[expat]
4 0.85 mit: expat licen[sc]e

[x11]
4 0.85 x11: (?:the )?x11 licen[sc]e

[bsd]
2 0.95 bsd-2-clause: (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:2|two) clause bsd licen[sc]e
2 0.95 bsd-3-clause: (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:3|three) clause bsd licen[sc]e
2 0.93 bsd: (?:licen[sc]ed|released|distributed|available) under (?:the |a )?bsd(?: style)? licen[sc]e
3 0.9 bsd-2-clause: (?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: licen[sc]e)?
3 0.9 bsd-3-clause: (?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: licen[sc]e)?
3 0.9 bsd-4-clause: (?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: licen[sc]e)?
3 0.9 bsd-2-clause: (?:simplified bsd|freebsd) licen[sc]e
3 0.9 bsd-3-clause: (?:new|modified|revised) bsd licen[sc]e
3 0.9 bsd-4-clause: (?:original|old) bsd licen[sc]e
3 0.9 0bsd: (?:zero clause bsd|0bsd)(?: licen[sc]e)?
4 0.75 bsd: bsd(?: style)? licen[sc]ed?

[isc licen]
4 0.85 isc: (?:the )?isc licen[sc]e

[mozilla]
1 0.98 mpl-2.0: this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
2 0.94 mpl: subject to the (?:terms of the )?mozilla public licen[sc]e
3 0.92 mpl-2.0: mozilla public licen[sc]e (?:version |v )?v?2 0
3 0.92 mpl-1.1: mozilla public licen[sc]e (?:version |v )?v?1 1
3 0.92 mpl-1.0: mozilla public licen[sc]e (?:version |v )?v?1 0
4 0.82 mpl: mozilla public licen[sc]e

[mpl]
3 0.85 mpl-2.0: mpl ?v?2 0
3 0.85 mpl-1.1: mpl ?v?1 1

[eclipse]
3 0.92 epl-2.0: eclipse public licen[sc]e (?:version |v )?v?2 0
3 0.92 epl-1.0: eclipse public licen[sc]e (?:version |v )?v?1 0
3 0.92 edl-1.0: eclipse distribution licen[sc]e (?:version |v )?v?1 0
4 0.82 epl: eclipse public licen[sc]e

[common development]
3 0.92 cddl-1.0: common development and distribution licen[sc]e (?:version |v )?v?1 0
3 0.92 cddl-1.1: common development and distribution licen[sc]e (?:version |v )?v?1 1
4 0.85 cddl: common development and distribution licen[sc]e

[cddl]
3 0.85 cddl-1.0: cddl ?v?1 0
3 0.85 cddl-1.1: cddl ?v?1 1
5 0.6 cddl: cddl

[common public]
3 0.92 cpl-1.0: common public licen[sc]e (?:version |v )?v?1 0
4 0.8 cpl: common public licen[sc]e

[common public attribution]
3 0.92 cpal-1.0: common public attribution licen[sc]e(?: version 1 0)?

[european union public]
3 0.92 eupl-1.2: european union public licen[sc]e (?:version |v )?v?1 2
3 0.92 eupl-1.1: european union public licen[sc]e (?:version |v )?v?1 1
4 0.85 eupl: european union public licen[sc]e

[eupl]
3 0.85 eupl-1.2: eupl ?v?1 2
3 0.85 eupl-1.1: eupl ?v?1 1
5 0.6 eupl: eupl

[artistic]
3 0.92 artistic-2.0: artistic licen[sc]e (?:version |v )?v?2 0
3 0.9 artistic-1.0: artistic licen[sc]e (?:version |v )?v?1 0
4 0.75 artistic: (?:the )?artistic licen[sc]e

[as perl]
1 0.9 perl: under the same terms as perl(?: 5| itself)?

[python software foundation]
3 0.9 python-2.0: python software foundation licen[sc]e (?:version |v )?2(?: 0)?
4 0.85 python: python software foundation licen[sc]e

[boost]
1 0.97 bsl-1.0: distributed under the boost software licen[sc]e version 1 0
3 0.92 bsl-1.0: boost software licen[sc]e(?: version)? ?v?1 0
4 0.85 bsl: boost software licen[sc]e

[zlib licen]
4 0.85 zlib: (?:the )?zlib licen[sc]e

[libpng]
4 0.85 libpng: (?:zlib )?libpng licen[sc]e

[openssl]
4 0.85 openssl: openssl licen[sc]e
1 0.9 openssl: this product includes software developed by the openssl project

[php]
3 0.9 php-3.01: php licen[sc]e (?:version |v )?3 01
3 0.9 php-3.0: php licen[sc]e (?:version |v )?3 0
4 0.75 php: php licen[sc]e

[ruby licen]
4 0.75 ruby: ruby licen[sc]e

[want to public]
1 0.95 wtfpl: do what the \S+ you want to public licen[sc]e(?: version 2)?

[wtfpl]
4 0.85 wtfpl: wtfpl(?: ?v?2)?

[unlicense]
4 0.85 unlicense: (?:the )?unlicense

[cc0]
3 0.95 cc0-1.0: (?:creative commons )?cc0 1 0(?: universal)?
4 0.8 cc0: (?:creative commons )?cc0

[creative commons zero]
3 0.92 cc0-1.0: creative commons zero(?: v?1 0)?

[public domain]
1 0.85 public-domain: (?:released|dedicated|placed) (?:in|into|to|under) the public domain
1 0.9 pddl-1.0: public domain dedication and licen[sc]e(?: v?1 0)?
3 0.9 cc-pdm: public domain mark(?: 1 0)?
5 0.5 public-domain: public domain

[creative commons attribution]
3 0.93 cc-by-4.0: creative commons attribution 4 0(?: international)?
3 0.93 cc-by-3.0: creative commons attribution 3 0(?: unported)?
3 0.93 cc-by-2.5: creative commons attribution 2 5
3 0.93 cc-by-2.0: creative commons attribution 2 0
3 0.93 cc-by-sa-4.0: creative commons attribution share ?alike 4 0(?: international)?
3 0.93 cc-by-sa-3.0: creative commons attribution share ?alike 3 0(?: unported)?
3 0.93 cc-by-nc-4.0: creative commons attribution non ?commercial 4 0(?: international)?
3 0.93 cc-by-nc-3.0: creative commons attribution non ?commercial 3 0(?: unported)?
3 0.93 cc-by-nd-4.0: creative commons attribution no ?deriv(?:ative|atives|s) 4 0(?: international)?
3 0.93 cc-by-nc-sa-4.0: creative commons attribution non ?commercial share ?alike 4 0(?: international)?
3 0.93 cc-by-nc-sa-3.0: creative commons attribution non ?commercial share ?alike 3 0(?: unported)?
3 0.93 cc-by-nc-nd-4.0: creative commons attribution non ?commercial no ?deriv(?:ative|atives|s) 4 0(?: international)?
3 0.93 cc-by-nc-nd-3.0: creative commons attribution non ?commercial no ?deriv(?:ative|atives|s) 3 0(?: unported)?
4 0.85 cc-by-sa: creative commons attribution share ?alike
4 0.85 cc-by-nc-nd: creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)
4 0.85 cc-by-nc-sa: creative commons attribution non ?commercial share ?alike
4 0.85 cc-by-nc: creative commons attribution non ?commercial
4 0.85 cc-by-nd: creative commons attribution no ?deriv(?:ative|atives|s)
4 0.8 cc-by: creative commons attribution

[creative commons licen]
5 0.6 creative-commons: creative commons licen[sc]ed?

[cc by]
2 0.96 cc-by-4.0: licen[sc]ed under (?:the )?cc by 4 0
2 0.96 cc-by-sa-4.0: licen[sc]ed under (?:the )?cc by sa 4 0
2 0.96 cc-by-nc-4.0: licen[sc]ed under (?:the )?cc by nc 4 0
2 0.96 cc-by-nd-4.0: licen[sc]ed under (?:the )?cc by nd 4 0
2 0.96 cc-by-nc-sa-4.0: licen[sc]ed under (?:the )?cc by nc sa 4 0
2 0.96 cc-by-nc-nd-4.0: licen[sc]ed under (?:the )?cc by nc nd 4 0
3 0.92 cc-by-4.0: cc by 4 0
3 0.92 cc-by-3.0: cc by 3 0
3 0.92 cc-by-2.5: cc by 2 5
3 0.92 cc-by-2.0: cc by 2 0
3 0.92 cc-by-sa-4.0: cc by sa 4 0
3 0.92 cc-by-sa-3.0: cc by sa 3 0
3 0.92 cc-by-sa-2.5: cc by sa 2 5
3 0.92 cc-by-nc-4.0: cc by nc 4 0
3 0.92 cc-by-nc-3.0: cc by nc 3 0
3 0.92 cc-by-nc-2.5: cc by nc 2 5
3 0.92 cc-by-nd-4.0: cc by nd 4 0
3 0.92 cc-by-nd-3.0: cc by nd 3 0
3 0.92 cc-by-nc-sa-4.0: cc by nc sa 4 0
3 0.92 cc-by-nc-sa-3.0: cc by nc sa 3 0
3 0.92 cc-by-nc-nd-4.0: cc by nc nd 4 0
3 0.92 cc-by-nc-nd-3.0: cc by nc nd 3 0
4 0.8 cc-by-sa: cc by sa
4 0.8 cc-by-nc-sa: cc by nc sa
4 0.8 cc-by-nc-nd: cc by nc nd
4 0.8 cc-by-nc: cc by nc
4 0.8 cc-by-nd: cc by nd
5 0.6 cc-by: cc by

[open font]
1 0.97 ofl-1.1: licen[sc]ed under the sil open font licen[sc]e version 1 1
3 0.92 ofl-1.1: (?:sil )?open font licen[sc]e (?:version |v )?v?1 1
3 0.9 ofl-1.0: (?:sil )?open font licen[sc]e (?:version |v )?v?1 0
4 0.85 ofl: (?:sil )?open font licen[sc]e

[open database]
3 0.92 odbl-1.0: open database licen[sc]e (?:version |v )?v?1 0
4 0.85 odbl: open database licen[sc]e

[open data commons]
3 0.92 odc-by-1.0: open data commons attribution licen[sc]e(?: v?1 0)?

[open software licen]
3 0.92 osl-3.0: open software licen[sc]e (?:version |v )?v?3 0
3 0.92 osl-2.1: open software licen[sc]e (?:version |v )?v?2 1
4 0.8 osl: open software licen[sc]e

[academic free]
3 0.92 afl-3.0: academic free licen[sc]e (?:version |v )?v?3 0
3 0.92 afl-2.1: academic free licen[sc]e (?:version |v )?v?2 1
4 0.82 afl: academic free licen[sc]e

[microsoft]
4 0.85 ms-pl: microsoft public licen[sc]e
4 0.85 ms-rl: microsoft reciprocal licen[sc]e

[server side public]
3 0.92 sspl-1.0: server side public licen[sc]e(?: (?:version |v )?v?1(?: 0)?)?

[business source]
3 0.92 busl-1.1: business source licen[sc]e(?: (?:version |v )?v?1 1)?

[elastic licen]
3 0.9 elastic-2.0: elastic licen[sc]e (?:version |v )?v?2(?: 0)?
4 0.8 elastic: elastic licen[sc]e

[commons clause]
4 0.85 commons-clause: commons clause licen[sc]e condition(?: v?1 0)?

[universal permissive]
3 0.9 upl-1.0: universal permissive licen[sc]e(?: v?1 0)?

[educational community]
3 0.9 ecl-2.0: educational community licen[sc]e(?: (?:version |v )?v?2 0)?

[postgresql licen]
4 0.85 postgresql: (?:the )?postgresql licen[sc]e

[vim licen]
4 0.8 vim: vim licen[sc]e

[cecill]
3 0.9 cecill-2.1: cecill(?: free software licen[sc]e)?(?: agreement)? (?:version |v )?v?2 1
3 0.9 cecill-b: cecill b
3 0.9 cecill-c: cecill c
5 0.6 cecill: cecill

[mulan]
3 0.9 mulan-2.0: mulan permissive software licen[sc]e(?: (?:version |v )?v?2)?

[blue oak]
3 0.9 blueoak-1.0.0: blue oak model licen[sc]e(?: 1 0 0)?

[free art]
3 0.9 lal: free art licen[sc]e(?: 1 3)?

[open government]
3 0.9 ogl-3.0: open government licen[sc]e v?(?:ersion )?3(?: 0)?
4 0.8 ogl: open government licen[sc]e

[openrail]
3 0.85 openrail: (?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?

[ncsa]
4 0.85 ncsa: (?:university of illinois )?ncsa open source licen[sc]e

[all rights reserved]
5 0.6 proprietary: all rights reserved

[proprietary]
4 0.75 proprietary: proprietary (?:and confidential|licen[sc]e)

[end user licen]
4 0.75 eula: end user licen[sc]e agreement
"""

#: Every text with a match of a rule holds one of these; texts without any are passed over.
GATES = (
    "licen", "spdx", "gpl", "mpl", "bsd", "public domain", "cc by", "cc0", "cddl", "eupl", "wtfpl", "cecill", "openrail", "all rights reserved", "proprietary and",
    "creative commons", "permission is hereby", "permission to use", "redistribution and use", "neither the name", "advertising materials", "altered source", "as perl", "openssl project",
)


def parsed() -> list[tuple[str, list[tuple[int, float, str, str]]]]:
    """The rules by keyword: (order, confidence, label, regex), orders made unique by the place of the line."""
    out: list[tuple[str, list[tuple[int, float, str, str]]]] = []
    place = 0
    for line in RULES.strip().splitlines():
        if line.startswith("["):
            out.append((line[1:-1], []))
        elif line:
            order, sure, rest = line.split(" ", 2)
            label, regex = re.match(r"([^:]+): (.+)", rest).groups()
            out[-1][1].append((int(order) * 1000 + place, float(sure), label, regex))
            place += 1
    return out
