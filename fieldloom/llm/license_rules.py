"""The ordered signature rules of the license scan, written by hand.

One rule a line: label, priority, keywords, regular expression. The expression
is matched against a line of lower-case words with one blank between two; a word
is a run of ASCII letters and digits or other letters, so "GPL-3.0" is "gpl 3 0".
Each keyword (joined by +) is a part of a word that every match holds; a text
without one of them is not searched. Priorities: 5 a license's own text, 4 an
identifier meant for machines, 3 a notice that names a license and says that it
applies, 2 a name with "license", 1 a bare name.
"""

from __future__ import annotations

TABLE = r"""
mit 5 permission+granted+charge permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 5 permission+granted+charge permission is hereby granted free of charge to any person obtaining a copy
mit 5 above+copyright+permission the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit 5 deal+restriction deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
mit-modern 5 permission+written+agreement permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute
x11 5 except+advertising+dealings except as contained in this notice the name of .{1,80}? shall not be used in advertising or otherwise to promote the sale use or other dealings
isc 5 permission+fee+purpose permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
isc 5 provided+above+copyright+permission provided that the above copyright notice and this permission notice appear in all copies
0bsd 5 permission+purpose+granted permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd 5 permission+documentation+fee permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted
bsd 5 redistribution+binary redistribution and use in source and binary forms with or without modification are permitted
bsd 5 redistributions+retain redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd 5 redistributions+reproduce redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3 5 neither+endorse neither the names? of .{1,120}? may be used to endorse or promote products derived from this software
bsd-4 5 advertising+acknowledg all advertising materials mentioning features or use of this software must display the following acknowledge?ment
zlib 5 altered+misrepresented altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib 5 origin+misrepresented the origin of this software must not be misrepresented you must not claim that you wrote the original software
boost-1 5 permission+granted+organization permission is hereby granted free of charge to any person or organization obtaining a copy of the software
apache-2 5 except+compliance+apache licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 5 except+compliance you may not use this file except in compliance with the license
apache-2 5 obtain+apache+org you may obtain a copy of the license at http www apache org licenses license 2 0
apache-1.1 5 product+apache this product includes software developed by the apache software foundation
gpl 5 redistribute+general+public you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
gpl-2+ 5 either+version+option general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3+ 5 either+version+option general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2 5 published+version+foundation gnu general public license version 2 as published by the free software foundation
gpl-2 5 published+version+foundation gnu general public license as published by the free software foundation version 2
gpl 5 received+general+along you should have received a copy of the gnu general public license along with
gpl 5 hope+useful+warranty this program is distributed in the hope that it will be useful but without any warranty
gpl-3 5 copyleft+kinds the gnu general public license is a free copyleft license for software and other kinds of works
gpl-2 5 licenses+designed+freedom the licenses for most software are designed to take away your freedom to share and change it
lgpl 5 redistribute+lesser you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl 5 redistribute+library you can redistribute it and or modify it under the terms of the gnu library general public license
lgpl-2.1+ 5 lesser+version+option lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3+ 5 lesser+version+option lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl 5 received+lesser you should have received a copy of the gnu lesser general public license
agpl 5 redistribute+affero you can redistribute it and or modify it under the terms of the gnu affero general public license
agpl-3+ 5 affero+version+option affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl 5 received+affero you should have received a copy of the gnu affero general public license
mpl-2 5 subject+mozilla+form this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 5 mpl+distributed if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 5 contents+mozilla+subject the contents of this file are subject to the mozilla public license version 1 1
epl-2 5 accompanying+eclipse this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0
epl-1 5 accompanying+eclipse this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
cddl 5 contents+common+development the contents of this file are subject to the terms of the common development and distribution license
artistic 5 intent+conditions+package the intent of this document is to state the conditions under which a package may be copied
artistic-2 5 everyone+permitted+changing everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
unlicense 5 unencumbered+public this is free and unencumbered software released into the public domain
unlicense 5 jurisdictions+recognize in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest
wtfpl 5 fuck+want you just do what the fuck you want to
cc0 5 deed+dedicated+domain the person who associated a work with this deed has dedicated the work to the public domain
cc0 5 dedicated+waiving dedicated the work to the public domain by waiving all of his or her rights
ofl 5 font+sold the font software may be sold as part of a larger software package but no copy of one or more of the original font software typefaces may be sold by itself
ofl 5 font+reserved no modified version of the font software may use the reserved font names?
cc-by 5 share+redistribute+attribution you are free to share copy and redistribute the material in any medium or format .{0,120}?attribution you must give appropriate credit
cc-by-nc 5 noncommercial+material noncommercial you may not use the material for commercial purposes
cc-by-sa 5 sharealike+remix sharealike if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nd 5 noderivatives+remix noderivatives if you remix transform or build upon the material you may not distribute the modified material
odbl 5 share+create+adapt+attribute you are free to share to create to adapt as long as you attribute
psf-2 5 psf+python+licensee psf is making python available to licensee on an as is basis
openssl 5 openssl+toolkit this product includes software developed by the openssl project for use in the openssl toolkit
proprietary 5 unauthorized+copying unauthorized copying of this file via any medium is strictly prohibited
proprietary 5 confidential+proprietary proprietary and confidential
proprietary 5 rights+reserved+reproduced all rights reserved no part of this .{1,60}? may be reproduced
warranty 5 provided+warranty+implied (?:the|this) software is provided as is without warranty of any kind express or implied
mit 4 spdx+mit spdx license identifier mit
mit-0 4 spdx+mit spdx license identifier mit 0
apache-2 4 spdx+apache spdx license identifier apache 2 0
apache-1.1 4 spdx+apache spdx license identifier apache 1 1
bsd-2 4 spdx+bsd spdx license identifier bsd 2 clause
bsd-3 4 spdx+bsd spdx license identifier bsd 3 clause
bsd-4 4 spdx+bsd spdx license identifier bsd 4 clause
0bsd 4 spdx+0bsd spdx license identifier 0bsd
gpl-2 4 spdx+gpl spdx license identifier gpl 2 0(?: only)?
gpl-2+ 4 spdx+gpl spdx license identifier gpl 2 0 or later
gpl-3 4 spdx+gpl spdx license identifier gpl 3 0(?: only)?
gpl-3+ 4 spdx+gpl spdx license identifier gpl 3 0 or later
lgpl-2 4 spdx+lgpl spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 4 spdx+lgpl spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1+ 4 spdx+lgpl spdx license identifier lgpl 2 1 or later
lgpl-3 4 spdx+lgpl spdx license identifier lgpl 3 0(?: only)?
lgpl-3+ 4 spdx+lgpl spdx license identifier lgpl 3 0 or later
agpl-3 4 spdx+agpl spdx license identifier agpl 3 0(?: only)?
agpl-3+ 4 spdx+agpl spdx license identifier agpl 3 0 or later
mpl-2 4 spdx+mpl spdx license identifier mpl 2 0
mpl-1.1 4 spdx+mpl spdx license identifier mpl 1 1
epl-1 4 spdx+epl spdx license identifier epl 1 0
epl-2 4 spdx+epl spdx license identifier epl 2 0
cddl 4 spdx+cddl spdx license identifier cddl 1 [01]
isc 4 spdx+isc spdx license identifier isc
zlib 4 spdx+zlib spdx license identifier zlib
boost-1 4 spdx+bsl spdx license identifier bsl 1 0
unlicense 4 spdx+unlicense spdx license identifier unlicense
wtfpl 4 spdx+wtfpl spdx license identifier wtfpl
cc0 4 spdx+cc0 spdx license identifier cc0 1 0
cc-by 4 spdx+cc spdx license identifier cc by [1-4] [05]
cc-by-sa 4 spdx+cc spdx license identifier cc by sa [1-4] [05]
cc-by-nc 4 spdx+cc spdx license identifier cc by nc [1-4] [05]
cc-by-nd 4 spdx+cc spdx license identifier cc by nd [1-4] [05]
cc-by-nc-sa 4 spdx+cc spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-nd 4 spdx+cc spdx license identifier cc by nc nd [1-4] [05]
artistic-2 4 spdx+artistic spdx license identifier artistic 2 0
eupl 4 spdx+eupl spdx license identifier eupl 1 [012]
ofl 4 spdx+ofl spdx license identifier ofl 1 [01]
odbl 4 spdx+odbl spdx license identifier odbl 1 0
psf-2 4 spdx+psf spdx license identifier psf 2 0
postgresql 4 spdx+postgresql spdx license identifier postgresql
ncsa 4 spdx+ncsa spdx license identifier ncsa
proprietary 4 spdx+proprietary spdx license identifier proprietary
cc-by 4 creativecommons+licenses creativecommons org licenses by(?: [1-4] [05])?
cc-by-sa 4 creativecommons+licenses creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nc 4 creativecommons+licenses creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd 4 creativecommons+licenses creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-nc-sa 4 creativecommons+licenses creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd 4 creativecommons+licenses creativecommons org licenses by nc nd(?: [1-4] [05])?
cc0 4 creativecommons+publicdomain creativecommons org publicdomain zero
public-domain 4 creativecommons+publicdomain creativecommons org publicdomain mark
mit 4 opensource+license+mit opensource org licenses? mit
bsd-2 4 opensource+license+bsd opensource org licenses? bsd 2 clause
bsd-3 4 opensource+license+bsd opensource org licenses? bsd 3 clause
apache-2 4 apache+org+licenses apache org licenses license 2 0
gpl 4 gnu+org+licenses gnu org licenses(?: old licenses)? gpl
lgpl 4 gnu+org+licenses gnu org licenses(?: old licenses)? lgpl
agpl 4 gnu+org+licenses gnu org licenses agpl
mpl-2 4 mozilla+org+mpl mozilla org mpl 2 0
mit 3 under+mit+licen (?:licen[cs]ed |released |distributed |available |published |provided )?under (?:the )?(?:terms of (?:the )?)?mit(?: x11)? licen[cs]e
mit 3 under+expat+licen under (?:the )?(?:terms of (?:the )?)?expat licen[cs]e
x11 3 under+x11+licen under (?:the )?(?:terms of (?:the )?)?x11 licen[cs]e
isc 3 under+isc+licen under (?:the )?(?:terms of (?:the )?)?isc licen[cs]e
zlib 3 under+zlib+licen under (?:the )?(?:terms of (?:the )?)?zlib(?: libpng)? licen[cs]e
bsd 3 under+bsd under (?:the |a )?(?:terms of (?:the )?)?bsd(?: style)? licen[cs]e
bsd-2 3 under+bsd+clause under (?:the )?(?:terms of (?:the )?)?(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[cs]e)?
bsd-2 3 under+simplified under (?:the )?(?:terms of (?:the )?)?(?:simplified bsd|freebsd)(?: licen[cs]e)?
bsd-3 3 under+bsd+clause under (?:the )?(?:terms of (?:the )?)?(?:bsd 3 clause|3 clause bsd)(?: licen[cs]e)?
bsd-3 3 under+bsd+new under (?:the )?(?:terms of (?:the )?)?new bsd licen[cs]e
bsd-3 3 under+bsd+modified under (?:the )?(?:terms of (?:the )?)?modified bsd licen[cs]e
apache-2 3 under+apache (?:licen[cs]ed |released |distributed |available |published |provided )?under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?(?: licen[cs]e)?
apache 3 under+apache+licen under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licen[cs]e
gpl-2 3 under+gpl (?:licen[cs]ed |released |distributed |available )?under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl ?v? ?2(?: 0)?(?: only)?
gpl-3 3 under+gpl (?:licen[cs]ed |released |distributed |available )?under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl ?v? ?3(?: 0)?(?: only)?
gpl 3 under+gpl (?:licen[cs]ed |released |distributed |available )?under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl(?: licen[cs]e)?
gpl-2 3 under+general+public under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e(?: version| v)? ?2(?: 0)?
gpl-3 3 under+general+public under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e(?: version| v)? ?3(?: 0)?
gpl 3 under+general+public under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public licen[cs]e
lgpl-2.1 3 under+lgpl under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl ?v? ?2 1
lgpl-3 3 under+lgpl under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl ?v? ?3(?: 0)?
lgpl 3 under+lgpl under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl
lgpl 3 under+lesser+general under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lesser general public licen[cs]e
agpl-3 3 under+agpl under (?:the )?(?:terms of (?:the )?)?(?:gnu )?agpl ?v? ?3(?: 0)?
agpl 3 under+agpl under (?:the )?(?:terms of (?:the )?)?(?:gnu )?agpl
agpl 3 under+affero under (?:the )?(?:terms of (?:the )?)?(?:gnu )?affero general public licen[cs]e
mpl-2 3 under+mpl under (?:the )?(?:terms of (?:the )?)?mpl ?v? ?2(?: 0)?
mpl-2 3 under+mozilla under (?:the )?(?:terms of (?:the )?)?mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?
mpl-1.1 3 under+mozilla under (?:the )?(?:terms of (?:the )?)?mozilla public licen[cs]e(?: version| v)? ?1 1
mpl 3 under+mozilla under (?:the )?(?:terms of (?:the )?)?mozilla public licen[cs]e
epl-2 3 under+eclipse under (?:the )?(?:terms of (?:the )?)?eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?
epl-1 3 under+eclipse under (?:the )?(?:terms of (?:the )?)?eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?
epl 3 under+eclipse under (?:the )?(?:terms of (?:the )?)?eclipse public licen[cs]e
cddl 3 under+cddl under (?:the )?(?:terms of (?:the )?)?cddl
cddl 3 under+common+distribution under (?:the )?(?:terms of (?:the )?)?common development and distribution licen[cs]e
artistic-2 3 under+artistic under (?:the )?(?:terms of (?:the )?)?artistic licen[cs]e(?: version)? 2(?: 0)?
artistic 3 under+artistic under (?:the )?(?:terms of (?:the )?)?artistic licen[cs]e
perl 3 under+perl+terms under the same terms as perl itself
boost-1 3 under+boost under (?:the )?(?:terms of (?:the )?)?boost(?: software)? licen[cs]e(?: version)?(?: 1 0)?
unlicense 3 under+unlicense under (?:the )?(?:terms of (?:the )?)?unlicense
wtfpl 3 under+wtfpl under (?:the )?(?:terms of (?:the )?)?wtfpl
ofl 3 under+font+licen under (?:the )?(?:terms of (?:the )?)?(?:sil )?open font licen[cs]e
odbl 3 under+database+licen under (?:the )?(?:terms of (?:the )?)?open (?:data commons open )?database licen[cs]e
eupl 3 under+eupl under (?:the )?(?:terms of (?:the )?)?eupl
eupl 3 under+european+union under (?:the )?(?:terms of (?:the )?)?european union public licen[cs]e
cc0 3 under+cc0 under (?:the )?(?:terms of (?:the )?)?(?:creative commons )?cc0(?: 1 0)?(?: licen[cs]e| waiver)?
cc-by 3 under+cc+by under (?:a |the )?(?:terms of (?:the )?)?cc by(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-sa 3 under+cc+by+sa under (?:a |the )?(?:terms of (?:the )?)?cc by sa(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc 3 under+cc+by+nc under (?:a |the )?(?:terms of (?:the )?)?cc by nc(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nd 3 under+cc+by+nd under (?:a |the )?(?:terms of (?:the )?)?cc by nd(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc-sa 3 under+cc+by+nc+sa under (?:a |the )?(?:terms of (?:the )?)?cc by nc sa(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc-nd 3 under+cc+by+nc+nd under (?:a |the )?(?:terms of (?:the )?)?cc by nc nd(?: [1-4] [05])?(?: licen[cs]e)?
cc-by 3 under+creative+commons under (?:a |the )?(?:terms of (?:the )?)?creative commons attribution(?: [1-4] [05])?(?: international)? licen[cs]e
cc-by-sa 3 under+creative+commons under (?:a |the )?(?:terms of (?:the )?)?creative commons attribution share ?alike(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
cc-by-nc 3 under+creative+commons under (?:a |the )?(?:terms of (?:the )?)?creative commons attribution non ?commercial(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
cc-by-nd 3 under+creative+commons under (?:a |the )?(?:terms of (?:the )?)?creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
psf-2 3 under+python+licen under (?:the )?(?:terms of (?:the )?)?python software foundation licen[cs]e(?: version 2)?
proprietary 3 under+proprietary+licen under (?:a |the )?proprietary licen[cs]e
commercial 3 under+commercial+licen under (?:a |the )?commercial licen[cs]e
public-domain 3 into+public+domain (?:released|dedicated|placed) (?:into|to|in) the public domain
public-domain 3 work+public+domain this (?:work|software|file|document|text) is in the public domain
proprietary 3 rights+reserved all rights reserved
mit 2 mit+licen (?:the )?mit(?: x11)? licen[cs]e
mit 2 mit+licen licen[cs]e(?:d)?(?: is| type)? mit
mit 2 expat+licen (?:the )?expat licen[cs]e
mit-0 2 mit+attribution+licen mit no attribution licen[cs]e
isc 2 isc+licen (?:the )?isc licen[cs]e
zlib 2 zlib+licen (?:the )?zlib(?: libpng)? licen[cs]e
x11 2 x11+licen (?:the )?x11 licen[cs]e
bsd 2 bsd+licen (?:the )?bsd(?: style)? licen[cs]e
bsd 2 bsd+licen licen[cs]e(?:d)? bsd
bsd-2 2 bsd+clause+licen (?:bsd 2 clause|2 clause bsd) licen[cs]e
bsd-2 2 bsd+simplified+licen simplified bsd licen[cs]e
bsd-3 2 bsd+clause+licen (?:bsd 3 clause|3 clause bsd) licen[cs]e
bsd-3 2 bsd+new+licen new bsd licen[cs]e
bsd-3 2 bsd+modified+licen modified bsd licen[cs]e
bsd-4 2 bsd+clause+licen (?:bsd 4 clause|4 clause bsd) licen[cs]e
bsd-4 2 bsd+original+licen original bsd licen[cs]e
apache-2 2 apache+licen (?:the )?apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?
apache-1.1 2 apache+licen (?:the )?apache(?: software)? licen[cs]e(?: version| v)? ?1 1
apache-2 2 apache+licen apache 2(?: 0)? licen[cs]e
apache 2 apache+licen (?:the )?apache(?: software)? licen[cs]e
gpl-2 2 general+public (?:gnu )?general public licen[cs]e(?: version| v)? ?2(?: 0)?
gpl-3 2 general+public (?:gnu )?general public licen[cs]e(?: version| v)? ?3(?: 0)?
gpl 2 general+public+licen (?:gnu )?general public licen[cs]e
lgpl-2.1 2 lesser+general+public (?:gnu )?lesser general public licen[cs]e(?: version| v)? ?2 1
lgpl-3 2 lesser+general+public (?:gnu )?lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?
lgpl 2 lesser+general+public (?:gnu )?lesser general public licen[cs]e
lgpl-2 2 library+general+public (?:gnu )?library general public licen[cs]e
agpl-3 2 affero+public (?:gnu )?affero general public licen[cs]e(?: version| v)? ?3(?: 0)?
agpl 2 affero+public (?:gnu )?affero general public licen[cs]e
gfdl 2 free+documentation+licen (?:gnu )?free documentation licen[cs]e
mpl-2 2 mozilla+public (?:the )?mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?
mpl-1.1 2 mozilla+public (?:the )?mozilla public licen[cs]e(?: version| v)? ?1 1
mpl 2 mozilla+public+licen (?:the )?mozilla public licen[cs]e
epl-2 2 eclipse+public (?:the )?eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?
epl-1 2 eclipse+public (?:the )?eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?
epl 2 eclipse+public+licen (?:the )?eclipse public licen[cs]e
cddl 2 common+development+licen common development and distribution licen[cs]e
cpl-1 2 common+public+licen common public licen[cs]e(?: version| v)?(?: ?1 0)?
ms-pl 2 microsoft+public+licen microsoft public licen[cs]e
ms-rl 2 microsoft+reciprocal+licen microsoft reciprocal licen[cs]e
artistic-2 2 artistic+licen (?:the )?artistic licen[cs]e(?: version)? 2(?: 0)?
artistic 2 artistic+licen (?:the )?artistic licen[cs]e
boost-1 2 boost+licen boost(?: software)? licen[cs]e(?: version)?(?: 1 0)?
wtfpl 2 want+public+licen do what the fuck you want to public licen[cs]e
ofl 2 font+licen (?:sil )?open font licen[cs]e(?: 1 1)?
odbl 2 database+licen open database licen[cs]e
odc-by 2 data+commons+attribution open data commons attribution licen[cs]e
pddl 2 public+dedication public domain dedication and licen[cs]e
eupl 2 european+union+public european union public licen[cs]e(?: version| v)?(?: ?1 [012])?
psf-2 2 python+foundation+licen python software foundation licen[cs]e
postgresql 2 postgresql+licen postgresql licen[cs]e
ncsa 2 illinois+licen university of illinois(?: ncsa)? open source licen[cs]e
php-3 2 php+licen php licen[cs]e(?: version)?(?: 3 01?)?
ruby 2 ruby+licen ruby licen[cs]e
openssl 2 openssl+licen openssl licen[cs]e
bzip2 2 bzip2+licen bzip2 licen[cs]e
json 2 json+licen json licen[cs]e
vim 2 vim+licen vim licen[cs]e
qpl 2 public+licen+q q public licen[cs]e
sspl-1 2 server+side+public server side public licen[cs]e
bsl-1.1 2 business+source+licen business source licen[cs]e
elastic-2 2 elastic+licen elastic licen[cs]e(?: version| v)?(?: ?2 0)?
cc-by 2 creative+commons+attribution creative commons attribution(?: [1-4] [05])? licen[cs]e
cc-by 2 creative+commons+attribution creative commons attribution [1-4] [05] (?:international|unported|generic)(?: licen[cs]e)?
openrail 2 openrail+licen (?:bigscience |creativeml )?openrail(?: m)? licen[cs]e
proprietary 2 proprietary+licen proprietary licen[cs]e
commercial 2 commercial+licen commercial licen[cs]e
mit-0 1 mit+0 mit 0
mit-0 1 mit+attribution mit no attribution
apache-2 1 apache apache(?: software)?(?: version| v)? ?2(?: 0)?
apache-1.1 1 apache apache(?: software)?(?: version| v)? ?1 1
gpl-2 1 general+public (?:gnu )?general public(?: version| v)? ?2(?: 0)?
gpl-3 1 general+public (?:gnu )?general public(?: version| v)? ?3(?: 0)?
gpl 1 gpl gpl
gpl-2 1 gpl (?:gnu )?gpl ?v? ?2(?: 0)?(?: only)?
gpl-3 1 gpl (?:gnu )?gpl ?v? ?3(?: 0)?(?: only)?
gpl-2+ 1 gpl (?:gnu )?gpl ?v? ?2(?: 0)? or later
gpl-3+ 1 gpl (?:gnu )?gpl ?v? ?3(?: 0)? or later
gpl 1 gpl gnu gpl
lgpl-2.1 1 lgpl (?:gnu )?lgpl ?v? ?2 1
lgpl-3 1 lgpl (?:gnu )?lgpl ?v? ?3(?: 0)?
lgpl 1 lgpl (?:gnu )?lgpl
agpl-3 1 agpl (?:gnu )?agpl ?v? ?3(?: 0)?
agpl 1 agpl (?:gnu )?agpl
mpl-2 1 mpl mpl ?v? ?2(?: 0)?
mpl-2 1 mozilla+public mozilla public(?: version| v)? ?2(?: 0)?
mpl-1.1 1 mozilla+public mozilla public(?: version| v)? ?1 1
epl-2 1 epl epl ?v? ?2(?: 0)?
epl-2 1 eclipse+public eclipse public(?: version| v)? ?2(?: 0)?
epl-1 1 eclipse+public eclipse public(?: version| v)? ?1(?: 0)?
artistic-2 1 artistic artistic 2(?: 0)?
boost-1 1 boost boost(?: software)?(?: version| v)? 1 0
bsd-2 1 bsd+clause bsd 2 clause
bsd-2 1 bsd+simplified simplified bsd
bsd-4 1 bsd+original original bsd
bsd-3 1 bsd+modified modified bsd
bsd-2 1 bsd+clause 2 clause bsd
bsd-3 1 bsd+clause bsd 3 clause
bsd-3 1 bsd+clause 3 clause bsd
bsd-4 1 bsd+clause bsd 4 clause
bsd-4 1 bsd+clause 4 clause bsd
bsd-3 1 bsd+new new bsd
cddl 1 cddl cddl(?: 1 [01])?
cc0 1 cc0 cc0(?: 1 0)?
cc-by 1 cc+by cc by(?: [1-4] [05])?
cc-by-sa 1 cc+by+sa cc by sa(?: [1-4] [05])?
cc-by-nc 1 cc+by+nc cc by nc(?: [1-4] [05])?
cc-by-nd 1 cc+by+nd cc by nd(?: [1-4] [05])?
cc-by-nc-sa 1 cc+by+nc+sa cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd 1 cc+by+nc+nd cc by nc nd(?: [1-4] [05])?
cc-by 1 creative+commons+attribution creative commons attribution
cc-by-sa 1 creative+commons+attribution creative commons attribution share ?alike
cc-by-nc 1 creative+commons+attribution creative commons attribution non ?commercial
cc-by-nd 1 creative+commons+attribution creative commons attribution no ?deriv(?:ative)?s?
cc-by-nc-sa 1 creative+commons+attribution creative commons attribution non ?commercial share ?alike
cc-by-nc-nd 1 creative+commons+attribution creative commons attribution non ?commercial no ?deriv(?:ative)?s?
wtfpl 1 wtfpl wtfpl
unlicense 1 unlicense unlicense
ofl 1 open+font open font
odbl 1 odbl odbl
eupl 1 eupl eupl(?: 1 [012])?
gfdl 1 gfdl gfdl
sspl-1 1 sspl sspl
openrail 1 openrail openrail(?: m)?
copyleft 1 copyleft copyleft
public-domain 1 public+domain public domain
"""


def rules() -> list[tuple[str, int, tuple[str, ...], str]]:
    """(label, priority, keywords, expression between word bounds) of each rule, in order."""
    lines = [line.split(" ", 3) for line in TABLE.strip().splitlines()]
    return [(label, int(priority), tuple(keywords.split("+")), f"(?<= )(?:{expression})(?= )") for label, priority, keywords, expression in lines]
