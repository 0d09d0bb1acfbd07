"""The signature rules of the license scan, written by hand, in their order.

A line reads ``priority | label | keywords | expression``. Expressions are read over the lower-cased words of
a text: a blank stands between two words, so a group like ``(?: the)?`` makes a word optional and
``(?:a|b)`` chooses one. All *keywords* of a rule are words that every match of it contains; a rule is tried only
on texts that have them all. Priorities: 9 texts and tags that name one license and version, 8 a license and
version, 7 a family, 5 words of a license text, 3 mentions.
"""

from __future__ import annotations

from typing import NamedTuple

RULES = r"""
9 | gpl-1.0 | gnu,1 | gnu general public license(?: as published by the free software foundation)?(?: either)? version 1
9 | gpl-2.0 | gnu,2 | gnu general public license(?: as published by the free software foundation)?(?: either)? version 2
9 | gpl-3.0 | gnu,3 | gnu general public license(?: as published by the free software foundation)?(?: either)? version 3
8 | gpl-1.0 | gnu,v1 | gnu (?:general public license|gpl) v1
8 | gpl-2.0 | gnu,v2 | gnu (?:general public license|gpl) v2
8 | gpl-3.0 | gnu,v3 | gnu (?:general public license|gpl) v3
8 | gpl-2.0 | gpl,2 | gpl(?: license)?(?: version)? 2(?: 0)?
8 | gpl-3.0 | gpl,3 | gpl(?: license)?(?: version)? 3(?: 0)?
8 | gpl-1.0 | gpl,1 | gpl(?: license)?(?: version)? 1(?: 0)?
8 | gpl-2.0 | gpl,v2 | gpl v2
8 | gpl-3.0 | gpl,v3 | gpl v3
8 | gpl-2.0 | gplv2 | gplv2(?: only)?
8 | gpl-3.0 | gplv3 | gplv3(?: only)?
9 | gpl-2.0-or-later | gplv2,later | gplv2 or(?: any)? later
9 | gpl-3.0-or-later | gplv3,later | gplv3 or(?: any)? later
9 | gpl-2.0-or-later | gpl,2,later | gpl(?: version)? 2(?: 0)? or(?: at your option any)? later
9 | gpl-3.0-or-later | gpl,3,later | gpl(?: version)? 3(?: 0)? or(?: at your option any)? later
9 | gpl-2.0-or-later | gnu,2,later | gnu general public license(?: as published by the free software foundation)?(?: either)? version 2(?: of the license)? or at your option any later version
9 | gpl-3.0-or-later | gnu,3,later | gnu general public license(?: as published by the free software foundation)?(?: either)? version 3(?: of the license)? or at your option any later version
9 | gpl-2.0-with-classpath-exception | gpl,classpath | gpl(?: version)? 2(?: 0)? with(?: the)? classpath exception
7 | gpl | gnu,gpl | gnu gpl
7 | gpl | gpl,licensed | licensed under(?: the)? gpl
7 | gpl | gpl,license | gpl license
7 | gpl | general,public,license | general public license
9 | lgpl-2.0 | library,2 | gnu library general public license(?: as published by the free software foundation)?(?: either)? version 2
9 | lgpl-2.1 | lesser,2 | gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 2 1
9 | lgpl-3.0 | lesser,3 | gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 3
8 | lgpl-2.0 | lgpl,2 | lgpl(?: version)? 2(?: 0)?
8 | lgpl-2.1 | lgpl,2,1 | lgpl(?: version)? 2 1
8 | lgpl-3.0 | lgpl,3 | lgpl(?: version)? 3(?: 0)?
8 | lgpl-2.1 | lgplv2 | lgplv2(?: 1)?
8 | lgpl-3.0 | lgplv3 | lgplv3
9 | lgpl-2.1-or-later | lgpl,2,1,later | lgpl(?: version)? 2 1 or(?: any)? later
9 | lgpl-3.0-or-later | lgpl,3,later | lgpl(?: version)? 3(?: 0)? or(?: any)? later
7 | lgpl | lesser,general,public | (?:gnu )?lesser general public license
7 | lgpl | library,general,public | (?:gnu )?library general public license
7 | lgpl | gnu,lgpl | gnu lgpl
9 | agpl-3.0 | affero,3 | (?:gnu )?affero general public license(?: as published by the free software foundation)?(?: either)? version 3
8 | agpl-1.0 | affero,1 | affero general public license version 1
8 | agpl-3.0 | agpl,3 | agpl(?: version)? 3(?: 0)?
8 | agpl-3.0 | agplv3 | agplv3
8 | agpl-3.0 | agpl,v3 | agpl v3
9 | agpl-3.0-or-later | agpl,3,later | agpl(?: version)? 3(?: 0)? or(?: any)? later
7 | agpl | affero,general,public | (?:gnu )?affero general public license
7 | agpl | gnu,agpl | gnu agpl
9 | gfdl-1.1 | documentation,1 | gnu free documentation license version 1 1
9 | gfdl-1.2 | documentation,1,2 | gnu free documentation license version 1 2
9 | gfdl-1.3 | documentation,1,3 | gnu free documentation license version 1 3
8 | gfdl-1.2 | gfdl,1,2 | gfdl(?: version)? 1 2
8 | gfdl-1.3 | gfdl,1,3 | gfdl(?: version)? 1 3
7 | gfdl | gnu,documentation | gnu free documentation license
7 | gfdl | gnu,fdl | gnu fdl
9 | gpl-1.0 | spdx,gpl,1 | spdx license identifier gpl 1 0(?: only| or later)?
9 | gpl-2.0 | spdx,gpl,2 | spdx license identifier gpl 2 0(?: only)?
9 | gpl-2.0-or-later | spdx,gpl,2,later | spdx license identifier gpl 2 0 or later
9 | gpl-3.0 | spdx,gpl,3 | spdx license identifier gpl 3 0(?: only)?
9 | gpl-3.0-or-later | spdx,gpl,3,later | spdx license identifier gpl 3 0 or later
9 | lgpl-2.1 | spdx,lgpl,2 | spdx license identifier lgpl 2 1(?: only| or later)?
9 | lgpl-3.0 | spdx,lgpl,3 | spdx license identifier lgpl 3 0(?: only| or later)?
9 | agpl-3.0 | spdx,agpl | spdx license identifier agpl 3 0(?: only| or later)?
9 | apache-2.0 | spdx,apache,2 | spdx license identifier apache 2 0
9 | mit | spdx,mit | spdx license identifier mit
9 | mit-0 | spdx,mit,0 | spdx license identifier mit 0
9 | isc | spdx,isc | spdx license identifier isc
9 | 0bsd | spdx,0bsd | spdx license identifier 0bsd
9 | bsd-2-clause | spdx,bsd,2 | spdx license identifier bsd 2 clause
9 | bsd-3-clause | spdx,bsd,3 | spdx license identifier bsd 3 clause
9 | mpl-2.0 | spdx,mpl | spdx license identifier mpl 2 0
9 | epl-2.0 | spdx,epl,2 | spdx license identifier epl 2 0
9 | bsl-1.0 | spdx,bsl | spdx license identifier bsl 1 0
9 | zlib | spdx,zlib | spdx license identifier zlib
9 | unlicense | spdx,unlicense | spdx license identifier unlicense
9 | cc0-1.0 | spdx,cc0 | spdx license identifier cc0 1 0
9 | cc-by-4.0 | spdx,cc,4 | spdx license identifier cc by 4 0
9 | cc-by-sa-4.0 | spdx,cc,sa,4 | spdx license identifier cc by sa 4 0
3 | spdx | spdx,identifier | spdx license identifier
9 | apache-1.0 | apache,1 | apache(?: software)? license version 1 0
9 | apache-1.1 | apache,1 | apache(?: software)? license version 1 1
9 | apache-2.0 | apache,2 | apache(?: software)? license version 2(?: 0)?
8 | apache-2.0 | apache,2 | apache(?: license)? 2(?: 0)?
8 | apache-1.1 | apache,1 | apache(?: license)? 1 1
8 | apache-2.0 | apache,v2 | apache(?: license)? v2(?: 0)?
8 | apache-2.0 | asl,2 | asl(?: version)? 2(?: 0)?
8 | apache-2.0 | apache,licenses,2 | apache org licenses license 2 0
9 | apache-2.0-with-llvm-exception | apache,llvm | apache(?: license)?(?: version)? 2 0 with(?: the)? llvm exceptions?
7 | apache | apache,license | apache(?: software)? license
7 | apache | apache,licensed | licensed under(?: the)? apache
5 | apache-2.0 | unless,applicable,writing | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
5 | apache-2.0 | contributor,perpetual,worldwide | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license
7 | mit | mit,license | (?:the )?mit license
7 | mit | mit,licence | (?:the )?mit licence
7 | mit | mit,licensed | mit licensed
7 | mit | mit,under | licensed under(?: the)? mit
7 | mit | expat,license | expat license
8 | mit-0 | mit,0 | mit 0(?: license)?
8 | mit-0 | mit,attribution | mit no attribution
8 | mit-cmu | cmu,license | cmu license
5 | mit | hereby,granted,charge,software | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
5 | mit | restriction,publish,sublicense | without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
5 | mit | copyright,permission,substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
5 | as-is-warranty | software,warranty,kind | the software is provided as is without warranty of any kind
5 | isc | permission,fee,hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
7 | isc | isc,license | isc license
7 | isc | isc,licensed | isc licensed
7 | x11 | x11,license | x11 license
9 | 0bsd | 0bsd | (?:license )?0bsd
9 | 0bsd | bsd,zero | bsd zero clause(?: license)?
9 | bsd-1-clause | bsd,1 | bsd 1 clause(?: license)?
9 | bsd-2-clause | bsd,2 | bsd 2 clause(?: license)?
9 | bsd-3-clause | bsd,3 | bsd 3 clause(?: license)?
9 | bsd-4-clause | bsd,4 | bsd 4 clause(?: license)?
8 | bsd-2-clause | bsd,simplified | simplified bsd(?: license)?
8 | bsd-2-clause | freebsd,license | freebsd license
8 | bsd-3-clause | bsd,new | new bsd license
8 | bsd-3-clause | bsd,revised | revised bsd license|bsd revised
8 | bsd-3-clause | bsd,modified | modified bsd license
8 | bsd-4-clause | bsd,original | original bsd license
8 | bsd-2-clause-patent | bsd,patent | bsd 2 clause plus patent license
8 | bsd-3-clause-clear | clear,bsd | clear bsd license
7 | bsd | bsd,license | bsd(?: style)? license
7 | bsd | bsd,licensed | bsd licensed
5 | bsd | redistribution,binary,permitted | redistribution and use in source and binary forms with or without modification are permitted
5 | bsd-3-clause | neither,endorse,promote | neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products
5 | bsd-4-clause | advertising,acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
9 | mpl-1.0 | mozilla,1,0 | mozilla public license(?: version)? 1 0
9 | mpl-1.1 | mozilla,1 | mozilla public license(?: version)? 1 1
9 | mpl-2.0 | mozilla,2 | mozilla public license(?: version)?(?: v)? 2(?: 0)?
8 | mpl-1.1 | mpl,1 | mpl(?: version)? 1 1
8 | mpl-2.0 | mpl,2 | mpl(?: version)? 2(?: 0)?
7 | mpl | mozilla,public,license | mozilla public license
9 | epl-1.0 | eclipse,1 | eclipse public license(?: version)?(?: v)? 1(?: 0)?
9 | epl-2.0 | eclipse,2 | eclipse public license(?: version)?(?: v)? 2(?: 0)?
8 | epl-1.0 | epl,1 | epl(?: version)? 1 0
8 | epl-2.0 | epl,2 | epl(?: version)? 2 0
7 | epl | eclipse,public,license | eclipse public license
8 | edl-1.0 | eclipse,distribution | eclipse distribution license(?: version)?(?: 1 0)?
9 | cddl-1.0 | cddl,1,0 | cddl(?: version)? 1 0
9 | cddl-1.1 | cddl,1 | cddl(?: version)? 1 1
7 | cddl | common,development,distribution | common development and distribution license
8 | cpl-1.0 | common,public,1 | common public license(?: version)? 1 0
7 | cpl | common,public,license | common public license
8 | ipl-1.0 | ibm,public,1 | ibm public license(?: version)? 1 0
7 | ipl | ibm,public,license | ibm public license
9 | artistic-1.0 | artistic,1 | artistic license(?: version)? 1 0
9 | artistic-2.0 | artistic,2 | artistic license(?: version)? 2 0
7 | artistic | artistic,license | artistic license
7 | perl | perl,terms | same terms as perl(?: itself)?
9 | bsl-1.0 | boost,1 | boost software license(?: version)? 1 0
7 | bsl | boost,software,license | boost software license
9 | busl-1.1 | business,source,1 | business source license(?: version)? 1 1
7 | busl | business,source,license | business source license
9 | sspl-1.0 | server,side,1 | server side public license(?: version)? 1
7 | sspl | server,side,public | server side public license
8 | sspl-1.0 | sspl | sspl(?: v1| 1 0)?
9 | elastic-2.0 | elastic,2 | elastic license(?: version)? 2 0
7 | elastic | elastic,license | elastic license
7 | commons-clause | commons,clause | commons clause(?: license)?
9 | psf-2.0 | python,foundation,2 | python software foundation license(?: version)? 2
7 | psf | python,foundation | python software foundation license
7 | python | python,license | python license
9 | php-3.01 | php,3 | php license(?: version)? 3 01
7 | php | php,license | php license
7 | ruby | ruby,license | ruby license
9 | ofl-1.1 | sil,1 | sil open font license(?: version)? 1 1
9 | ofl-1.1 | ofl,1 | ofl(?: version)? 1 1
7 | ofl | open,font,license | (?:sil )?open font license
7 | openssl | openssl,license | openssl license
8 | zlib | zlib,libpng | zlib libpng license
7 | zlib | zlib,license | zlib license
7 | libpng | libpng,license | libpng license
5 | zlib | altered,misrepresented | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
7 | ncsa | illinois,ncsa | (?:university of )?illinois ncsa open source license
7 | postgresql | postgresql,license | postgresql license
7 | curl | curl,license | curl license
7 | json | json,license | json license
5 | json | good,evil | the software shall be used for good not evil
7 | beerware | beerware | beerware(?: license)?
7 | beerware | beer,ware | beer ware license
8 | wtfpl | wtfpl | wtfpl(?: version 2| v2)?
8 | wtfpl | fuck,public | do what the fuck you want to public license
8 | unlicense | unlicense | (?:the )?unlicense(?: license)?
5 | unlicense | unencumbered,domain | this is free and unencumbered software released into the public domain
7 | public-domain | public,domain,released | released (?:in)?to the public domain
7 | public-domain | public,domain,dedicated | dedicated to the public domain
7 | public-domain | public,domain,placed | placed (?:in|into) the public domain
3 | public-domain | public,domain | (?:in the )?public domain
9 | cc0-1.0 | cc0,1 | cc0 1 0(?: universal)?
7 | cc0 | cc0 | cc0
8 | cc0-1.0 | creative,commons,zero | creative commons zero(?: v1 0| 1 0)?
9 | cc-by-1.0 | cc,by,1 | cc by 1 0
9 | cc-by-2.0 | cc,by,2 | cc by 2 0
9 | cc-by-2.5 | cc,by,2,5 | cc by 2 5
9 | cc-by-3.0 | cc,by,3 | cc by 3 0
9 | cc-by-4.0 | cc,by,4 | cc by 4 0
9 | cc-by-sa-1.0 | cc,by,sa,1 | cc by sa 1 0
9 | cc-by-sa-2.0 | cc,by,sa,2 | cc by sa 2 0
9 | cc-by-sa-2.5 | cc,by,sa,5 | cc by sa 2 5
9 | cc-by-sa-3.0 | cc,by,sa,3 | cc by sa 3 0
9 | cc-by-sa-4.0 | cc,by,sa,4 | cc by sa 4 0
9 | cc-by-nc-1.0 | cc,by,nc,1 | cc by nc 1 0
9 | cc-by-nc-2.0 | cc,by,nc,2 | cc by nc 2 0
9 | cc-by-nc-2.5 | cc,by,nc,5 | cc by nc 2 5
9 | cc-by-nc-3.0 | cc,by,nc,3 | cc by nc 3 0
9 | cc-by-nc-4.0 | cc,by,nc,4 | cc by nc 4 0
9 | cc-by-nd-2.0 | cc,by,nd,2 | cc by nd 2 0
9 | cc-by-nd-3.0 | cc,by,nd,3 | cc by nd 3 0
9 | cc-by-nd-4.0 | cc,by,nd,4 | cc by nd 4 0
9 | cc-by-nc-sa-2.0 | cc,by,nc,sa,2 | cc by nc sa 2 0
9 | cc-by-nc-sa-2.5 | cc,by,nc,sa,5 | cc by nc sa 2 5
9 | cc-by-nc-sa-3.0 | cc,by,nc,sa,3 | cc by nc sa 3 0
9 | cc-by-nc-sa-4.0 | cc,by,nc,sa,4 | cc by nc sa 4 0
9 | cc-by-nc-nd-2.0 | cc,by,nc,nd,2 | cc by nc nd 2 0
9 | cc-by-nc-nd-2.5 | cc,by,nc,nd,5 | cc by nc nd 2 5
9 | cc-by-nc-nd-3.0 | cc,by,nc,nd,3 | cc by nc nd 3 0
9 | cc-by-nc-nd-4.0 | cc,by,nc,nd,4 | cc by nc nd 4 0
7 | cc-by-sa | cc,by,sa | cc by sa
7 | cc-by-nc | cc,by,nc | cc by nc
7 | cc-by-nd | cc,by,nd | cc by nd
7 | cc-by-nc-sa | cc,by,nc,sa | cc by nc sa
7 | cc-by-nc-nd | cc,by,nc,nd | cc by nc nd
7 | cc-by | cc,by | cc by
9 | cc-by-4.0 | commons,attribution,4 | creative commons attribution 4 0 international
9 | cc-by-3.0 | commons,attribution,3 | creative commons attribution 3 0(?: unported)?
9 | cc-by-sa-4.0 | commons,attribution,sharealike,4 | creative commons attribution sharealike 4 0 international
9 | cc-by-sa-3.0 | commons,attribution,sharealike,3 | creative commons attribution sharealike 3 0(?: unported)?
9 | cc-by-sa-4.0 | commons,attribution,share,alike,4 | creative commons attribution share alike 4 0(?: international)?
9 | cc-by-nc-4.0 | commons,noncommercial,4 | creative commons attribution noncommercial 4 0(?: international)?
9 | cc-by-nc-4.0 | commons,commercial,4 | creative commons attribution non commercial 4 0(?: international)?
9 | cc-by-nd-4.0 | commons,noderivatives,4 | creative commons attribution noderivatives 4 0(?: international)?
9 | cc-by-nc-sa-4.0 | commons,noncommercial,sharealike,4 | creative commons attribution noncommercial sharealike 4 0(?: international)?
9 | cc-by-nc-nd-4.0 | commons,noncommercial,noderivatives,4 | creative commons attribution noncommercial noderivatives 4 0(?: international)?
8 | cc-by-4.0 | creativecommons,by,4 | creativecommons org licenses by 4 0
8 | cc-by-3.0 | creativecommons,by,3 | creativecommons org licenses by 3 0
8 | cc-by-sa-4.0 | creativecommons,by,sa,4 | creativecommons org licenses by sa 4 0
8 | cc-by-sa-3.0 | creativecommons,by,sa,3 | creativecommons org licenses by sa 3 0
8 | cc-by-nc-4.0 | creativecommons,by,nc,4 | creativecommons org licenses by nc 4 0
8 | cc-by-nc-sa-4.0 | creativecommons,by,nc,sa,4 | creativecommons org licenses by nc sa 4 0
8 | cc-by-nc-nd-4.0 | creativecommons,by,nc,nd,4 | creativecommons org licenses by nc nd 4 0
8 | cc0-1.0 | creativecommons,zero | creativecommons org publicdomain zero 1 0
7 | cc-by-sa | commons,sharealike | creative commons attribution sharealike
7 | cc-by-nc | commons,noncommercial | creative commons attribution noncommercial
7 | cc-by | commons,attribution | creative commons attribution
7 | cc | creative,commons,license | creative commons license
3 | cc | creative,commons | creative commons
9 | odbl-1.0 | odbl,1 | odbl(?: version)? 1 0
7 | odbl | open,database,license | open database license
8 | odc-by-1.0 | odc,by | odc by(?: 1 0)?
7 | pddl | pddl | pddl(?: 1 0)?
8 | eupl-1.1 | eupl,1 | eupl(?: version)? 1 1
8 | eupl-1.2 | eupl,1,2 | eupl(?: version)? 1 2
7 | eupl | european,union,public | european union public licen[cs]e
7 | cecill | cecill | cecill(?: b| c| 2 1)?
7 | ms-pl | microsoft,public,license | microsoft public license
7 | ms-rl | microsoft,reciprocal | microsoft reciprocal license
8 | ms-pl | ms,pl | ms pl
9 | afl-3.0 | academic,3 | academic free license(?: version)? 3 0
7 | afl | academic,free,license | academic free license
9 | osl-3.0 | osl,3 | osl(?: version)? 3 0
7 | osl | open,software,license | open software license
7 | upl-1.0 | universal,permissive | universal permissive license(?: version)?(?: 1 0)?
7 | vim | vim,license | vim license
7 | w3c | w3c,license | w3c(?: software)?(?: notice and)? license
7 | tcl | tcl,license | tcl(?: tk)? license
7 | icu | icu,license | icu license
7 | unicode | unicode,license | unicode license(?: agreement)?
7 | nasa-1.3 | nasa,agreement | nasa open source agreement(?: version)?(?: 1 3)?
7 | bittorrent | bittorrent,license | bittorrent open source license
7 | sun-public | sun,public,license | sun public license
7 | sleepycat | sleepycat,license | sleepycat license
7 | zpl-2.1 | zope,public | zope public license(?: version)?(?: 2 1)?
7 | openrail | openrail | (?:creativeml )?openrail(?: m)?
7 | bigscience-rail | bigscience,rail | bigscience rail license
7 | llama-community | llama,community,license | llama (?:2 |3 |3 1 )?community license
7 | proprietary | proprietary,license | proprietary license
7 | proprietary | proprietary,confidential | proprietary and confidential
7 | eula | eula | eula
7 | eula | end,user,license | end user license agreement
5 | all-rights-reserved | rights,reserved | all rights reserved
5 | gpl | redistribute,gnu,modify | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
5 | gpl | received,gnu,copy | you should have received a copy of the gnu general public license
5 | lgpl | received,lesser,copy | you should have received a copy of the gnu lesser general public license
5 | agpl | received,affero,copy | you should have received a copy of the gnu affero general public license
5 | warranty-disclaimer | warranty,merchantability | without even the implied warranty of merchantability or fitness for a particular purpose
3 | license-reference | see,license,file | see(?: the)? license file
3 | license-reference | license,details,for | see(?: the)? license for(?: more)? details
3 | license-notice | licensed,terms | licensed under the terms of
3 | license-notice | licensed,work | this work is licensed
3 | dual-license | dual,licensed | dual licensed
3 | dual-license | dual,license | dual license
3 | copyright | copyright,c | copyright c (?:[0-9]{4}|the|by)
3 | copyright | copyright,by | copyright by
"""


class Rule(NamedTuple):
    """One signature: its place in the order, priority, label, required words and expression."""

    number: int
    priority: int
    label: str
    keywords: tuple[str, ...]
    expression: str


def read_rules(text: str = RULES) -> list[Rule]:
    """The rules of a table in the notation above."""
    rules = []
    for line in filter(None, map(str.strip, text.splitlines())):
        priority, label, keywords, expression = (part.strip() for part in line.split(" | ", 3))
        rules.append(Rule(len(rules), int(priority), label, tuple(keywords.split(",")), expression))
    return rules
