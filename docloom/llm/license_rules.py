"""The ordered signatures of license texts, written for texts of lower-case words with one space between.

A line is: label | tier | words that must be there | regex [| values for %]. A line with values stands for one rule
for each of them, with % replaced in the label by the value and in the regex by its words. Tiers: 4 is the wording of a license or a
machine-readable tag, 3 a grant or name with its version, 2 a name, 1 a hint. Earlier lines win among equal
spans of one tier.
"""

from __future__ import annotations

from typing import NamedTuple

#: Phrases whose places every text is searched for, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

CONFIDENCE = {1: 0.25, 2: 0.5, 3: 0.8, 4: 1.0}

SIGNATURES = r"""
mit | 4 | hereby,granted | permission is hereby granted free of charge to any person obtaining a copy
mit | 4 | noninfringement | warranties of merchantability fitness for a particular purpose and noninfringement
mit | 4 | substantial,portions | (?:this|the above copyright notice and this) permission notice shall be included in all copies or substantial portions
mit | 4 | spdx,mit | spdx license identifier mit
mit | 3 | mit | (?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of (?:the )?)?mit licen[cs]e
mit | 3 | mit | (?:see|read) the mit licen[cs]e
mit | 2 | mit | (?:the )?mit licen[cs]e
mit | 2 | expat | (?:the )?expat licen[cs]e
mit-x11 | 2 | x11 | (?:mit )?x11 licen[cs]e
mit-0 | 2 | mit | mit (?:no attribution|0) licen[cs]e
mit-0 | 4 | spdx,mit | spdx license identifier mit 0
x11-advertising | 4 | x,consortium | name of the x consortium shall not be used in advertising
isc | 4 | permission,fee | permission to use copy modify and or distribute this software for any purpose with or without fee
isc | 4 | spdx,isc | spdx license identifier isc
isc | 2 | isc | (?:the )?isc licen[cs]e
0bsd | 2 | bsd | (?:bsd zero clause|zero clause bsd|0 clause bsd)(?: licen[cs]e)?
0bsd | 2 | 0bsd | 0bsd(?: licen[cs]e)?
bsd | 4 | binary,permitted | redistributions? and use in source and binary forms with or without modification are permitted
bsd | 4 | redistributions,source | redistributions of source code must retain the (?:above|accompanying) copyright
bsd | 4 | redistributions,binary | redistributions in binary form must reproduce the above copyright
bsd-3-clause | 4 | endorse | neither the names? of [^ ]+ (?:[^ ]+ ){0,8}may be used to endorse or promote products
bsd-4-clause | 4 | advertising | all advertising materials mentioning features or use of this software must display
bsd-2-clause | 4 | views,conclusions | views and conclusions contained in the software and documentation are those of the authors
bsd-%-clause | 4 | spdx,bsd | spdx license identifier bsd % clause | 1,2,3,4
bsd-%-clause | 3 | bsd,clause | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?bsd % clause licen[cs]e | 1,2,3,4
bsd-%-clause | 2 | bsd,clause | (?:bsd % clause|% clause bsd)(?: licen[cs]e)? | 1,2,3,4
bsd-2-clause | 2 | simplified | simplified bsd licen[cs]e
bsd-2-clause | 2 | freebsd | freebsd licen[cs]e
bsd-3-clause | 2 | bsd | (?:new|revised|modified|modern) bsd licen[cs]e
bsd-3-clause | 2 | three | three clause bsd(?: licen[cs]e)?
bsd-2-clause | 2 | two | two clause bsd(?: licen[cs]e)?
bsd-4-clause | 2 | bsd | (?:original|old|four clause) bsd licen[cs]e
bsd | 3 | bsd | (?:licensed|released|distributed|available) under (?:the |a )?(?:terms of (?:the )?)?bsd(?: style)? licen[cs]e
bsd | 2 | bsd | (?:the )?bsd(?: style)? licen[cs]e
apache-2.0 | 4 | apache,version | licensed under the apache licen[cs]e version 2 0 the license
apache-2.0 | 4 | compliance,license | you may not use this file except in compliance with the license
apache-2.0 | 4 | apache,licenses | apache org licenses license 2 0(?: txt| html)?
apache-% | 4 | spdx,apache | spdx license identifier apache % | 1.0,1.1,2.0
apache-% | 3 | apache | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licen[cs]e (?:version |v )?% | 1.0,1.1,2.0
apache-% | 3 | apache | apache(?: software)? licen[cs]e (?:version |v )?% | 1.0,1.1,2.0
apache-2.0 | 3 | apache | (?:apache 2 licen[cs]e|apache licen[cs]e (?:v2|version 2|2))
apache-2.0 | 2 | asl | asl (?:2 0|v2)
apache | 2 | apache | (?:the )?apache(?: software)? licen[cs]e
apache | 1 | apache,foundation | licensed to the apache software foundation
gpl-% | 4 | spdx,gpl | spdx license identifier gpl %(?: only)? | 1.0,2.0,3.0
gpl-%-or-later | 4 | spdx,gpl | spdx license identifier gpl % or later | 1.0,2.0,3.0
gpl-%-or-later | 4 | redistribute,gnu | redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version % of the license or | 1,2,3
gpl-text | 4 | gnu,foundation | under the terms of the gnu general public licen[cs]e as published by the free software foundation
gpl-text | 4 | useful,warranty | distributed in the hope that it will be useful but without any warranty
gpl-text | 4 | received,gnu | you should have received a copy of the gnu general public licen[cs]e
gpl-%.0 | 3 | general,public | (?:gnu )?general public licen[cs]e (?:gpl )?(?:version |v )?%(?: 0)? | 1,2,3
gpl-%.0 | 3 | general,public | version % of the (?:gnu )?general public licen[cs]e | 1,2,3
gpl-%.0 | 3 | gpl | (?:gnu )?gpl (?:version |v )?%(?: 0)? | 1,2,3
gpl-1.0 | 3 | gplv1 | (?:gnu )?gplv1
gpl-2.0 | 3 | gplv2 | (?:gnu )?gplv2
gpl-3.0 | 3 | gplv3 | (?:gnu )?gplv3
gpl-2.0-or-later | 3 | gplv2 | (?:gnu )?gplv2 or later
gpl-3.0-or-later | 3 | gplv3 | (?:gnu )?gplv3 or later
gpl-unversioned | 3 | general,public | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e
gpl-unversioned | 2 | gnu,general | gnu general public licen[cs]e
gpl-unversioned | 2 | gnu,gpl | gnu gpl
gpl-unversioned | 1 | gpl | (?:the )?gpl licen[cs]e
gpl-unversioned | 1 | gpl | under (?:the )?gpl
gpl-classpath-exception | 4 | classpath | gnu general public licen[cs]e (?:version 2 )?with (?:the )?classpath exception
gpl-linking-exception | 4 | linking,statically | linking this library statically or dynamically with other modules
gpl-font-exception | 4 | font,exception | (?:gpl|general public licen[cs]e) (?:version [0-9] )?with (?:the )?font exception
gcc-exception-3.1 | 4 | gcc,runtime | gcc runtime library exception(?: version 3 1)?
lgpl-% | 4 | spdx,lgpl | spdx license identifier lgpl %(?: only| or later)? | 2.0,2.1,3.0
lgpl | 4 | lesser,foundation | under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation
lgpl-% | 3 | lesser | (?:gnu )?lesser general public licen[cs]e (?:version |v )?% | 2.1,3
lgpl-2.0 | 3 | library,general | (?:gnu )?library general public licen[cs]e(?: (?:version |v )?2(?: 0)?)?
lgpl-% | 3 | lgpl | (?:gnu )?lgpl (?:version |v )?% | 2.0,2.1,3.0,3
lgpl-3.0 | 3 | lgplv3 | lgplv3
lgpl-2.1 | 3 | lgplv2 | lgplv2(?: 1)?
lgpl | 2 | lesser | (?:gnu )?lesser general public licen[cs]e
lgpl | 1 | lgpl | (?:gnu )?lgpl(?: licen[cs]e)?
agpl-% | 4 | spdx,agpl | spdx license identifier agpl %(?: only| or later)? | 1.0,3.0
agpl | 4 | affero,foundation | under the terms of the gnu affero general public licen[cs]e as published by the free software foundation
agpl-3.0 | 3 | affero | (?:gnu )?affero general public licen[cs]e (?:version |v )?3(?: 0)?
agpl-3.0 | 3 | agpl | (?:gnu )?agpl (?:version |v )?3(?: 0)?
agpl-3.0 | 3 | agplv3 | agplv3
agpl | 2 | affero | (?:gnu )?affero general public licen[cs]e
agpl | 1 | agpl | (?:gnu )?agpl(?: licen[cs]e)?
gfdl-% | 4 | spdx,gfdl | spdx license identifier gfdl %(?: only| or later)? | 1.1,1.2,1.3
gfdl | 4 | invariant,sections | with no invariant sections no front cover texts and no back cover texts
gfdl-% | 3 | documentation | (?:gnu )?free documentation licen[cs]e (?:version |v )?% | 1.1,1.2,1.3
gfdl | 2 | documentation | (?:gnu )?free documentation licen[cs]e
gfdl | 1 | gfdl | gfdl
mpl-% | 4 | spdx,mpl | spdx license identifier mpl % | 1.0,1.1,2.0
mpl-2.0 | 4 | mozilla,source | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-1.1 | 4 | mozilla,contents | the contents of this file are subject to the mozilla public licen[cs]e version 1 1
mpl-% | 3 | mozilla | mozilla public licen[cs]e (?:version |v )?% | 1.0,1.1,2.0
mpl-% | 3 | mpl | mpl (?:version |v )?% | 1.0,1.1,2.0
mpl | 2 | mozilla | mozilla public licen[cs]e
epl-% | 4 | spdx,epl | spdx license identifier epl % | 1.0,2.0
epl-% | 3 | eclipse | eclipse public licen[cs]e (?:version |v )?% | 1.0,2.0
epl | 2 | eclipse | eclipse public licen[cs]e
edl-1.0 | 2 | eclipse,distribution | eclipse distribution licen[cs]e(?: (?:version |v )?1 0)?
cddl-% | 4 | spdx,cddl | spdx license identifier cddl % | 1.0,1.1
cddl-% | 3 | distribution | common development and distribution licen[cs]e (?:cddl )?(?:version |v )?% | 1.0,1.1
cddl | 2 | distribution | common development and distribution licen[cs]e
cddl | 1 | cddl | cddl(?: licen[cs]e)?
cpl-1.0 | 2 | common,public | common public licen[cs]e(?: (?:version |v )?1 0)?
ipl-1.0 | 2 | ibm,public | ibm public licen[cs]e(?: (?:version |v )?1 0)?
eupl-% | 3 | european | european union public licen[cs]e (?:eupl )?(?:version |v )?% | 1.0,1.1,1.2
eupl | 2 | european | european union public licen[cs]e
eupl-% | 3 | eupl | eupl (?:version |v )?% | 1.0,1.1,1.2
cecill-% | 3 | cecill | cecill (?:version |v )?% | 1.0,2.0,2.1
cecill-b | 2 | cecill | cecill b(?: licen[cs]e)?
cecill-c | 2 | cecill | cecill c(?: licen[cs]e)?
cecill | 2 | cecill | (?:licen[cs]e cecill|cecill licen[cs]e)
artistic-% | 4 | spdx,artistic | spdx license identifier artistic % | 1.0,2.0
artistic-% | 3 | artistic | (?:the )?artistic licen[cs]e (?:version |v )?% | 1.0,2.0
artistic | 2 | artistic | (?:the )?artistic licen[cs]e
perl | 3 | perl | under the same terms as perl(?: itself)?
python-2.0 | 3 | psf | psf licen[cs]e(?: (?:version |v )?2(?: 0)?)?
python-2.0 | 3 | python,foundation | python software foundation licen[cs]e(?: (?:version |v )?2(?: 0)?)?
python-2.0 | 2 | python | python licen[cs]e
ruby | 2 | ruby | ruby licen[cs]e
php-% | 3 | php | php licen[cs]e (?:version |v )?% | 3.0,3.01
php | 2 | php | (?:the )?php licen[cs]e
zlib | 4 | zlib,spdx | spdx license identifier zlib
zlib | 4 | altered,misrepresented | altered source versions must be plainly marked as such and must not be misrepresented
zlib | 2 | zlib | zlib(?: libpng)? licen[cs]e
libpng | 2 | libpng | libpng licen[cs]e
bsl-1.0 | 4 | bsl,spdx | spdx license identifier bsl 1 0
bsl-1.0 | 3 | boost | (?:distributed under the )?boost software licen[cs]e(?: (?:version |v )?1 0)?
openssl | 2 | openssl | openssl licen[cs]e
ncsa | 2 | ncsa | (?:university of illinois )?ncsa open source licen[cs]e
unlicense | 4 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 4 | unlicense,spdx | spdx license identifier unlicense
unlicense | 2 | unlicense | (?:the )?unlicense
wtfpl | 4 | wtfpl,spdx | spdx license identifier wtfpl
wtfpl | 2 | wtfpl | wtfpl
wtfpl | 3 | want,public | do what the fuck you want to public licen[cs]e
beerware | 3 | beer,ware | (?:the )?beer ware licen[cs]e
beerware | 3 | beerware | (?:the )?beerware licen[cs]e
json | 4 | evil | the software shall be used for good not evil
vim | 2 | vim | vim licen[cs]e
sqlite-blessing | 4 | blessing | the author disclaims copyright to this source code in place of a legal notice here is a blessing
ofl-% | 3 | sil,font | sil open font licen[cs]e (?:version |v )?% | 1.0,1.1
ofl | 2 | font | (?:sil )?open font licen[cs]e
ofl | 4 | font,reserved | with reserved font name
lppl-% | 3 | latex | latex project public licen[cs]e (?:version |v )?% | 1.0,1.2,1.3
lppl | 2 | latex | latex project public licen[cs]e
w3c | 2 | w3c | w3c software(?: and document)?(?: notice and)? licen[cs]e
afl-% | 3 | academic | academic free licen[cs]e (?:version |v )?% | 1.1,1.2,2.0,2.1,3.0
afl | 2 | academic | academic free licen[cs]e
osl-% | 3 | open,software | open software licen[cs]e (?:version |v )?% | 1.0,2.0,2.1,3.0
osl | 2 | open,software | open software licen[cs]e
ms-pl | 2 | microsoft | microsoft public licen[cs]e
ms-rl | 2 | microsoft | microsoft reciprocal licen[cs]e
apsl-% | 3 | apple | apple public source licen[cs]e (?:version |v )?% | 1.0,1.1,1.2,2.0
apsl | 2 | apple | apple public source licen[cs]e
sspl-1.0 | 3 | server,side | server side public licen[cs]e(?: (?:version |v )?1(?: 0)?)?
elastic-2.0 | 3 | elastic | elastic licen[cs]e(?: (?:version |v )?2(?: 0)?)?
busl-1.1 | 3 | business | business source licen[cs]e(?: (?:version |v )?1 1)?
commons-clause | 3 | commons,clause | commons clause(?: licen[cs]e condition)?(?: v?1 0)?
blueoak-1.0.0 | 3 | oak | blue oak model licen[cs]e(?: 1 0 0)?
mulan-psl-% | 3 | mulan | mulan (?:permissive software licen[cs]e|psl) (?:version |v )?% | 1,2
upl-1.0 | 3 | universal,permissive | universal permissive licen[cs]e(?: (?:version |v )?1 0)?
postgresql | 2 | postgresql | postgresql licen[cs]e
ogl-uk-% | 3 | government | open government licen[cs]e (?:version |v )?%(?: 0)? | 1,2,3
ogl | 2 | government | open government licen[cs]e
odbl-1.0 | 3 | database | open (?:data commons open )?database licen[cs]e(?: (?:odbl )?(?:version |v )?1 0)?
odc-by-1.0 | 3 | commons,attribution | open data commons attribution licen[cs]e(?: (?:version |v )?1 0)?
pddl-1.0 | 3 | commons,domain | open data commons public domain dedication(?: and licen[cs]e)?
cdla-permissive-% | 3 | community,data | community data licen[cs]e agreement permissive(?: (?:version |v )?%)? | 1.0,2.0
cdla-sharing-1.0 | 3 | community,data | community data licen[cs]e agreement sharing(?: (?:version |v )?1 0)?
llama-% | 3 | llama | llama % community licen[cs]e(?: agreement)? | 2,3,3.1,3.2,3.3
openrail-m | 3 | openrail | (?:creativeml |bigcode |bigscience )?openrail m(?: licen[cs]e)?
cc0-1.0 | 4 | cc0,spdx | spdx license identifier cc0 1 0
cc0-1.0 | 4 | creativecommons | creativecommons org publicdomain zero 1 0
cc0-1.0 | 3 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 3 | zero,commons | creative commons zero(?: (?:licen[cs]e|v1 0|1 0))?
cc-pdm-1.0 | 4 | creativecommons | creativecommons org publicdomain mark 1 0
public-domain | 3 | public,domain | (?:dedicated|released|placed) (?:in|in to|into|to) the public domain
public-domain | 2 | public,domain | (?:is|are) (?:in )?the public domain
public-domain | 1 | public,domain | public domain
cc-by-% | 4 | cc,spdx | spdx license identifier cc by % | 1.0,2.0,2.5,3.0,4.0
cc-by-sa-% | 4 | cc,spdx | spdx license identifier cc by sa % | 1.0,2.0,2.5,3.0,4.0
cc-by-nc-% | 4 | cc,spdx | spdx license identifier cc by nc % | 1.0,2.0,2.5,3.0,4.0
cc-by-nd-% | 4 | cc,spdx | spdx license identifier cc by nd % | 1.0,2.0,2.5,3.0,4.0
cc-by-% | 4 | creativecommons,by | creativecommons org licenses by % | 1.0,2.0,2.5,3.0,4.0
cc-by-sa-% | 4 | creativecommons,by | creativecommons org licenses by sa % | 1.0,2.0,2.5,3.0,4.0
cc-by-nc-% | 4 | creativecommons,by | creativecommons org licenses by nc % | 1.0,2.0,2.5,3.0,4.0
cc-by-nd-% | 4 | creativecommons,by | creativecommons org licenses by nd % | 1.0,2.0,2.5,3.0,4.0
cc-by-nc-sa-% | 4 | creativecommons,by | creativecommons org licenses by nc sa % | 1.0,2.0,2.5,3.0,4.0
cc-by-nc-nd-% | 4 | creativecommons,by | creativecommons org licenses by nc nd % | 1.0,2.0,2.5,3.0,4.0
cc-by-% | 3 | cc,by | (?:licensed under )?cc by % | 1.0,2.0,2.5,3.0,4.0
cc-by-sa-% | 3 | cc,sa | (?:licensed under )?cc by sa % | 1.0,2.0,2.5,3.0,4.0
cc-by-nc-% | 3 | cc,nc | (?:licensed under )?cc by nc % | 1.0,2.0,2.5,3.0,4.0
cc-by-nd-% | 3 | cc,nd | (?:licensed under )?cc by nd % | 1.0,2.0,2.5,3.0,4.0
cc-by-nc-sa-% | 3 | cc,nc | (?:licensed under )?cc by nc sa % | 1.0,2.0,2.5,3.0,4.0
cc-by-nc-nd-% | 3 | cc,nc | (?:licensed under )?cc by nc nd % | 1.0,2.0,2.5,3.0,4.0
cc-by-% | 3 | creative,attribution | creative commons attribution (?:licen[cs]e )?(?:version |v )?%(?: international| unported| generic)? | 1.0,2.0,2.5,3.0,4.0
cc-by-sa-% | 3 | creative,attribution | creative commons attribution share ?alike (?:licen[cs]e )?(?:version |v )?%(?: international| unported| generic)? | 1.0,2.0,2.5,3.0,4.0
cc-by-nc-% | 3 | creative,attribution | creative commons attribution non ?commercial (?:licen[cs]e )?(?:version |v )?%(?: international| unported| generic)? | 1.0,2.0,2.5,3.0,4.0
cc-by-nd-% | 3 | creative,attribution | creative commons attribution no ?deriv(?:ative)?s (?:licen[cs]e )?(?:version |v )?%(?: international| unported| generic)? | 1.0,2.0,2.5,3.0,4.0
cc-by-nc-sa-% | 3 | creative,attribution | creative commons attribution non ?commercial share ?alike (?:licen[cs]e )?(?:version |v )?%(?: international| unported| generic)? | 1.0,2.0,2.5,3.0,4.0
cc-by-nc-nd-% | 3 | creative,attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s (?:licen[cs]e )?(?:version |v )?%(?: international| unported| generic)? | 1.0,2.0,2.5,3.0,4.0
cc-by-sa | 2 | cc,sa | cc by sa
cc-by-nc | 2 | cc,nc | cc by nc
cc-by-nd | 2 | cc,nd | cc by nd
cc-by-nc-sa | 2 | cc,nc | cc by nc sa
cc-by-nc-nd | 2 | cc,nc | cc by nc nd
cc-unversioned | 2 | creative,commons | creative commons attribution(?: share ?alike| non ?commercial| no ?deriv(?:ative)?s){0,2} licen[cs]e
cc-unversioned | 2 | creative,commons | (?:licensed|released|available|published) under (?:a |the )?creative commons(?: licen[cs]e)?
cc-unversioned | 1 | creative,commons | creative commons
copyright | 3 | copyright,reserved | copyright (?:c )?(?:19|20)[0-9]{2} (?:[^ ]+ ){1,8}all rights reserved
copyright | 2 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?(?: by)?
copyright | 2 | copyright | (?:19|20)[0-9]{2} copyright
copyright | 1 | copyright | copyright
reserved-some | 3 | reserved,some | some rights reserved
reserved-none | 3 | reserved,no | no rights reserved
proprietary | 3 | proprietary,confidential | (?:proprietary and confidential|confidential and proprietary)(?: information)?
proprietary | 3 | prohibited | unauthori[sz]ed (?:copying|reproduction|use|distribution|duplication)(?: or (?:copying|reproduction|use|distribution|duplication))? (?:[^ ]+ ){0,8}(?:is|are) (?:strictly )?prohibited
proprietary | 3 | reproduced,without | (?:may|must|can) not be reproduced (?:[^ ]+ ){0,12}without (?:the )?(?:prior |express |written )+(?:permission|consent)
proprietary | 3 | reproduced,part | no part of this (?:publication|book|work|document|site) may be reproduced
proprietary | 2 | end,user | end user licen[cs]e agreement
proprietary | 2 | proprietary | proprietary licen[cs]e
non-commercial | 3 | commercial,only | (?:for )?non commercial (?:use|purposes|research)(?: purposes)? only
non-commercial | 3 | noncommercial,only | (?:for )?noncommercial (?:use|purposes|research)(?: purposes)? only
non-commercial | 3 | commercial,prohibited | commercial use (?:of [^ ]+ (?:[^ ]+ ){0,4})?is (?:strictly )?prohibited
research-only | 3 | research,only | for (?:academic )?research (?:use|purposes) only
royalty-free | 2 | royalty,free | royalty free licen[cs]e
as-is | 3 | warranty,kind | (?:provided )?as is without warranty of any kind
as-is | 2 | without | without (?:any )?(?:express or implied )?warrant(?:y|ies)
lizenz-cc | 3 | lizenz,creative | creative commons lizenz
lizenz-vorbehalten | 3 | rechte,vorbehalten | alle rechte vorbehalten
licence-reserve | 3 | droits,réservés | tous droits réservés
licence-libre | 2 | licence,libre | (?:sous )?licence libre
licencia-reservados | 3 | derechos,reservados | todos los derechos reservados
licencia-libre | 2 | licencia,libre | (?:bajo )?licencia libre
"""


class Rule(NamedTuple):
    no: int
    label: str
    tier: int
    needs: tuple[str, ...]
    regex: str
    base: bool


def spaced(phrase: str) -> str:
    """A regex of words with one space between as one for texts in which every word has a space on either side, so that neighbouring matches share none."""
    return f" (?:{phrase.replace('[^ ]', chr(0)).replace(' ?', chr(1)).replace(' ', '  ').replace(chr(1), '(?:  )?').replace(chr(0), '[^ ]')}) "


def rules(signatures: str = SIGNATURES) -> list[Rule]:
    """The base phrases, then all signatures in order."""
    found = [(label, 1, tuple(phrase.split(" ")), phrase, True) for phrase, label in BASE.items()]
    for line in filter(None, map(str.strip, signatures.splitlines())):
        label, tier, needs, regex, *values = [x.strip() for x in line.replace("(?:licence|license) cecill|cecill licen[cs]e", "licen[cs]e cecill").rsplit(" | ")]
        for v in values[0].split(",") if values else [""]:
            found.append((label.replace("%", v), int(tier), tuple(needs.split(",")), regex.replace("%", v.replace(".", " ")), False))
    return [Rule(no, label, tier, needs, spaced(regex), base) for no, (label, tier, needs, regex, base) in enumerate(found)]
