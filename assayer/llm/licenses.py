"""Licence scans by sentence rules.  DataFrame functions only.

Lines are freed of comment marks, bullets and list numbers at their start.  Blank lines end a
paragraph; within it sentences end after . ! ? ; : before white space, or go on over line ends,
as texts are wrapped.  A sentence is normalised (A-Z in lower case, everything but a-z and
0-9 to one space, names in fixed phrases to a placeholder) and looked up among known licence
sentences.  If it is none, the parts of it on each line are looked up, since short notices often stand
on a line without a full stop around them.  The identifiers found, in order, are then matched
against the licence rules in their order: a rule is a sequence of identifiers that must
follow each other, with no other known sentence between; sentences that a rule has
used are not used again.  So a family's long rules stand before its short ones.
Whole licence files are known by their title, opening and closing sentences.  A line with the tag
``SPDX-License-Identifier:`` is cut at OR and AND; each name is a sentence of its own.

Null and empty texts have no sentences.  Each row is judged alone, repeated rows alike; extra
columns stay behind.  A text of any length is one row in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Names in fixed phrases that differ from text to text: pattern and form, tried in order on normalised sentences.
PLACEHOLDERS = [
    (r"^neither the names? of .+ nor the names of (its|their|any|the) contributors may be used", "neither the name of x nor the names of its contributors may be used"),
    (r"^this software is provided by .+ as is and any express", "this software is provided by x as is and any express"),
    (r"^in no event shall .+ be liable for any direct indirect", "in no event shall x be liable for any direct indirect"),
    (r"^in no event shall .+ be liable for any claim damages", "in no event shall x be liable for any claim damages"),
    (r"^in no event shall .+ be liable for any special direct", "in no event shall x be liable for any special direct"),
    (r"^(the software|software) is provided as is and .+ disclaims all warranties", "the software is provided as is and x disclaims all warranties"),
    (r"^[a-z0-9 ]+ is free software$", "this program is free software"),
    (r"^[a-z0-9 ]+ is distributed in the hope that it will be useful but", "this program is distributed in the hope that it will be useful but"),
    (r"^(released|licensed|distributed|available|provided|published|made available) under (the |a )?(terms of )?(the )?", "licensed under the "),
    (r"^(this|the) (work|file|software|project|program|code|library|source code|document|text|page|content) is (released|licensed|distributed|available|provided|published|made available) under (the |a )?(terms of )?(the )?", "licensed under the "),
]
#: What every sentence that a placeholder changes matches, begins with or holds; the others are spared the patterns.
_MAY_CHANGE = r"^(neither the name|this software is provided|in no event shall|the software is provided|software is provided|(this|the) [a-z]+( code)? is [a-z]+( available)? under|(released|licensed|distributed|available|provided|published|made available) under)"
_MAY_HOLD = (" is free software", " is distributed in the hope that it will be useful but")

_SHORT = {
    "apache-short": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"],
    "mit-short": ["mit license"],
    "bsd-short": ["bsd license"],
    "bsd2-short": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "bsd3-short": ["bsd 3 clause license", "3 clause bsd license", "new bsd license"],
    "isc-short": ["isc license"],
    "zlib-short": ["zlib license"],
    "boost-short": ["boost software license version 1 0"],
    "mpl2-short": ["mozilla public license version 2 0", "mozilla public license v 2 0"],
    "epl2-short": ["eclipse public license version 2 0", "eclipse public license v 2 0"],
    "gpl2-short": ["gnu general public license version 2", "gnu gpl version 2", "gpl version 2"],
    "gpl3-short": ["gnu general public license version 3", "gnu gpl version 3", "gpl version 3"],
    "lgpl21-short": ["gnu lesser general public license version 2 1", "lgpl version 2 1"],
    "lgpl3-short": ["gnu lesser general public license version 3", "lgpl version 3"],
    "agpl3-short": ["gnu affero general public license version 3", "agpl version 3"],
    "cc-by-short": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "cc-by-sa-short": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc-short": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "cc-by-nd-short": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
}

#: Names in SPDX tags, in normal form, by licence and class.
_SPDX = {
    ("Apache-2.0", "permissive"): ["apache 2 0"],
    ("MIT", "permissive"): ["mit"],
    ("BSD-2-Clause", "permissive"): ["bsd 2 clause"],
    ("BSD-3-Clause", "permissive"): ["bsd 3 clause"],
    ("BSD-4-Clause", "permissive"): ["bsd 4 clause"],
    ("ISC", "permissive"): ["isc"],
    ("0BSD", "permissive"): ["0bsd"],
    ("Zlib", "permissive"): ["zlib"],
    ("BSL-1.0", "permissive"): ["bsl 1 0"],
    ("Unlicense", "permissive"): ["unlicense"],
    ("WTFPL", "permissive"): ["wtfpl"],
    ("CC0-1.0", "permissive"): ["cc0 1 0"],
    ("MPL-2.0", "copyleft"): ["mpl 2 0", "mpl 2 0 no copyleft exception"],
    ("EPL-2.0", "copyleft"): ["epl 2 0"],
    ("GPL-2.0", "copyleft"): ["gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later"],
    ("GPL-3.0", "copyleft"): ["gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"],
    ("LGPL-2.1", "copyleft"): ["lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later"],
    ("LGPL-3.0", "copyleft"): ["lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later"],
    ("AGPL-3.0", "copyleft"): ["agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"],
    ("CC-BY-SA-4.0", "copyleft"): ["cc by sa 4 0"],
    ("CC-BY-4.0", "permissive"): ["cc by 4 0"],
    ("CC-BY-NC-4.0", "restricted"): ["cc by nc 4 0"],
    ("CC-BY-ND-4.0", "restricted"): ["cc by nd 4 0"],
    ("CC-BY-NC-SA-4.0", "restricted"): ["cc by nc sa 4 0"],
    ("CC-BY-NC-ND-4.0", "restricted"): ["cc by nc nd 4 0"],
}

#: Titles, opening and closing sentences of whole licence files, in normal form, by identifier.
_FILES = {
    "apache-title": ["apache license version 2 0 january 2004 http www apache org licenses", "apache license version 2 0 january 2004 https www apache org licenses", "apache license version 2 0 january 2004"],
    "apache-terms": ["terms and conditions for use reproduction and distribution"],
    "apache-definition": ["license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document"],
    "apache-closing": ["however in accepting such obligations you may act only on your own behalf and on your sole responsibility not on behalf of any other contributor and only if you agree to indemnify defend and hold each contributor harmless for any liability incurred by or claims asserted against such contributor by reason of your accepting any such warranty or additional liability"],
    "gpl2-title": ["gnu general public license version 2 june 1991"],
    "gpl2-closing": ["in no event unless required by applicable law or agreed to in writing will any copyright holder or any other party who may modify and or redistribute the program as permitted above be liable to you for damages including any general special incidental or consequential damages arising out of the use or inability to use the program including but not limited to loss of data or data being rendered inaccurate or losses sustained by you or third parties or a failure of the program to operate with any other programs even if such holder or other party has been advised of the possibility of such damages"],
    "gnu-preamble": ["the licenses for most software are designed to take away your freedom to share and change it"],
    "gpl3-title": ["gnu general public license version 3 29 june 2007"],
    "gpl3-preamble": ["the gnu general public license is a free copyleft license for software and other kinds of works"],
    "lgpl21-title": ["gnu lesser general public license version 2 1 february 1999"],
    "lgpl3-title": ["gnu lesser general public license version 3 29 june 2007"],
    "lgpl3-opening": ["this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below"],
    "agpl3-title": ["gnu affero general public license version 3 19 november 2007"],
    "agpl3-preamble": ["the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"],
    "mpl2-title": ["mozilla public license version 2 0"],
    "mpl2-definition": ["contributor means each individual or legal entity that creates contributes to the creation of or owns covered software"],
    "epl2-title": ["eclipse public license v 2 0"],
    "epl-terms": ["the accompanying program is provided under the terms of this eclipse public license agreement"],
    "cc0-title": ["cc0 1 0 universal"],
    "cc-by-title": ["creative commons attribution 4 0 international public license"],
    "cc-by-sa-title": ["creative commons attribution sharealike 4 0 international public license"],
    "cc-by-nc-title": ["creative commons attribution noncommercial 4 0 international public license"],
    "cc-by-nd-title": ["creative commons attribution noderivatives 4 0 international public license"],
    "cc-by-nc-sa-title": ["creative commons attribution noncommercial sharealike 4 0 international public license"],
    "cc-by-nc-nd-title": ["creative commons attribution noncommercial noderivatives 4 0 international public license"],
}

#: Known sentences in normal form, by identifier.
SENTENCES = {
    **{name: [f"licensed under the {form}" for form in forms] for name, forms in _SHORT.items()},
    **{"spdx-" + name.lower(): [f"spdx license identifier {form}" for form in forms] for (name, _), forms in _SPDX.items()},
    **_FILES,
    "apache-notice": ["licensed under the apache license version 2 0 the license"],
    "apache-compliance": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "apache-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "the software is provided as is without warranty of any kind express or implied"],
    "mit-liability": ["in no event shall x be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of x nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-advertising": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd-as-is": ["this software is provided by x as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd-liability": ["in no event shall x be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-as-is": ["the software is provided as is and x disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "isc-liability": ["in no event shall x be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"],
    "bsd0-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "gpl-free": ["this program is free software"],
    "gpl-terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl-terms": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "gnu-v2": ["either version 2 of the license or at your option any later version"],
    "gnu-v21": ["either version 2 1 of the license or at your option any later version"],
    "gnu-v3": ["either version 3 of the license or at your option any later version"],
    "gpl2-grant": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"],
    "gpl3-grant": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "lgpl21-grant": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "lgpl3-grant": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl3-grant": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "mpl2-notice": ["this source code form is subject to the terms of the mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v"],
    "mpl2-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https"],
    "unlicense-domain": ["this is free and unencumbered software released into the public domain"],
    "unlicense-anyone": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "zlib-as-is": ["this software is provided as is without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-liability": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "boost-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "epl2-notice": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution"],
    "wtfpl": ["you just do what the fuck you want to", "do what the fuck you want to public license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "this work is dedicated to the public domain under cc0 1 0"],
    "reserved": ["all rights reserved"],
}

#: Rules in order: licence, class, sequence of identifiers.
RULES = [
    ("Apache-2.0", "permissive", ["apache-title", "apache-terms", "apache-definition", "apache-closing"]),
    ("Apache-2.0", "permissive", ["apache-title", "apache-terms", "apache-definition"]),
    ("Apache-2.0", "permissive", ["apache-title", "apache-terms"]),
    ("GPL-2.0", "copyleft", ["gpl2-title", "gnu-preamble", "gpl2-closing"]),
    ("GPL-2.0", "copyleft", ["gpl2-title", "gnu-preamble"]),
    ("GPL-3.0", "copyleft", ["gpl3-title", "gpl3-preamble"]),
    ("LGPL-2.1", "copyleft", ["lgpl21-title", "gnu-preamble"]),
    ("LGPL-3.0", "copyleft", ["lgpl3-title", "lgpl3-opening"]),
    ("AGPL-3.0", "copyleft", ["agpl3-title", "agpl3-preamble"]),
    ("MPL-2.0", "copyleft", ["mpl2-title", "mpl2-definition"]),
    ("EPL-2.0", "copyleft", ["epl2-title", "epl-terms"]),
    ("Apache-2.0", "permissive", ["apache-notice", "apache-compliance", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", "permissive", ["apache-notice", "apache-compliance", "apache-copy"]),
    ("Apache-2.0", "permissive", ["apache-notice", "apache-compliance"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice"]),
    ("BSD-4-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising"]),
    ("BSD-3-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD", "permissive", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD", "permissive", ["bsd-grant", "bsd-source"]),
    ("ISC", "permissive", ["isc-grant", "isc-as-is", "isc-liability"]),
    ("ISC", "permissive", ["isc-grant", "isc-as-is"]),
    ("0BSD", "permissive", ["bsd0-grant", "isc-as-is"]),
    ("GPL-2.0", "copyleft", ["gpl-free", "gpl2-grant"]),
    ("GPL-2.0", "copyleft", ["gpl-free", "gpl-terms", "gnu-v2"]),
    ("GPL-3.0", "copyleft", ["gpl-free", "gpl-terms", "gnu-v3"]),
    ("LGPL-2.1", "copyleft", ["gpl-free", "lgpl-terms", "gnu-v21"]),
    ("LGPL-3.0", "copyleft", ["gpl-free", "lgpl-terms", "gnu-v3"]),
    ("GPL-3.0", "copyleft", ["gpl-free", "gpl3-grant"]),
    ("LGPL-2.1", "copyleft", ["gpl-free", "lgpl21-grant"]),
    ("LGPL-3.0", "copyleft", ["gpl-free", "lgpl3-grant"]),
    ("AGPL-3.0", "copyleft", ["gpl-free", "agpl3-grant"]),
    ("MPL-2.0", "copyleft", ["mpl2-notice", "mpl2-copy"]),
    ("MPL-2.0", "copyleft", ["mpl2-notice"]),
    ("Unlicense", "permissive", ["unlicense-domain", "unlicense-anyone"]),
    ("Zlib", "permissive", ["zlib-as-is", "zlib-liability", "zlib-grant"]),
    ("Zlib", "permissive", ["zlib-as-is", "zlib-grant"]),
    ("BSL-1.0", "permissive", ["boost-grant"]),
    ("EPL-2.0", "copyleft", ["epl2-notice"]),
    ("WTFPL", "permissive", ["wtfpl"]),
    ("CC0-1.0", "permissive", ["cc0"]),
    *((name, kind, ["spdx-" + name.lower()]) for name, kind in _SPDX),
    ("Apache-2.0", "permissive", ["apache-title"]),
    ("Apache-2.0", "permissive", ["apache-closing"]),
    ("GPL-2.0", "copyleft", ["gpl2-title"]),
    ("GPL-2.0", "copyleft", ["gpl2-closing"]),
    ("GPL-3.0", "copyleft", ["gpl3-title"]),
    ("GPL-3.0", "copyleft", ["gpl3-preamble"]),
    ("LGPL-2.1", "copyleft", ["lgpl21-title"]),
    ("LGPL-3.0", "copyleft", ["lgpl3-title"]),
    ("LGPL-3.0", "copyleft", ["lgpl3-opening"]),
    ("AGPL-3.0", "copyleft", ["agpl3-title"]),
    ("AGPL-3.0", "copyleft", ["agpl3-preamble"]),
    ("MPL-2.0", "copyleft", ["mpl2-title"]),
    ("MPL-2.0", "copyleft", ["mpl2-definition"]),
    ("EPL-2.0", "copyleft", ["epl2-title"]),
    ("CC0-1.0", "permissive", ["cc0-title"]),
    ("CC-BY-4.0", "permissive", ["cc-by-title"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc-by-sa-title"]),
    ("CC-BY-NC-4.0", "restricted", ["cc-by-nc-title"]),
    ("CC-BY-ND-4.0", "restricted", ["cc-by-nd-title"]),
    ("CC-BY-NC-SA-4.0", "restricted", ["cc-by-nc-sa-title"]),
    ("CC-BY-NC-ND-4.0", "restricted", ["cc-by-nc-nd-title"]),
    ("Apache-2.0", "permissive", ["apache-short"]),
    ("Apache-2.0", "permissive", ["apache-notice"]),
    ("MIT", "permissive", ["mit-short"]),
    ("BSD-2-Clause", "permissive", ["bsd2-short"]),
    ("BSD-3-Clause", "permissive", ["bsd3-short"]),
    ("BSD", "permissive", ["bsd-short"]),
    ("ISC", "permissive", ["isc-short"]),
    ("Zlib", "permissive", ["zlib-short"]),
    ("BSL-1.0", "permissive", ["boost-short"]),
    ("MPL-2.0", "copyleft", ["mpl2-short"]),
    ("EPL-2.0", "copyleft", ["epl2-short"]),
    ("GPL-2.0", "copyleft", ["gpl2-short"]),
    ("GPL-3.0", "copyleft", ["gpl3-short"]),
    ("LGPL-2.1", "copyleft", ["lgpl21-short"]),
    ("LGPL-3.0", "copyleft", ["lgpl3-short"]),
    ("AGPL-3.0", "copyleft", ["agpl3-short"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc-by-sa-short"]),
    ("CC-BY-NC-4.0", "restricted", ["cc-by-nc-short"]),
    ("CC-BY-ND-4.0", "restricted", ["cc-by-nd-short"]),
    ("CC-BY-4.0", "permissive", ["cc-by-short"]),
    ("Proprietary", "restricted", ["reserved"]),
]

_STOP = "\x01"
#: White space, comment marks, then a bullet or list number, at the start of a line.
_MARKS = r"(^|\n)[ \t]*(?:(?://+|/\*+|\*+/?|#+|;+|--+|<!--|%+|>+)[ \t]*)*(?:(?:[-*]|\(?[0-9]{1,2}[.)]|\(?[a-z]\))[ \t]+)?"
_BLANK = r"\n[ \t]*\n[ \t\n]*"
_END = r"([.!?;:])[ \t\n]+"
_TAG = "SPDX-License-Identifier:"
_JOINT = r"[ \t]+(?:OR|AND)[ \t]+"
_NAME = r"SPDX-License-Identifier:[ \t(]*([A-Za-z0-9.+-]+)"


def _plain(s: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")))


def _canonical(s: Column) -> Column:
    out = s
    for pattern, form in PLACEHOLDERS:
        out = F.regexp_replace(out, pattern, form)
    return F.when(s.rlike(_MAY_CHANGE) | s.contains(_MAY_HOLD[0]) | s.contains(_MAY_HOLD[1]), out).otherwise(s)


def sentences(text: Column) -> Column:
    """Array of (whole, parts): each sentence in normal form, and its lines if there are several; empty ones left out."""
    clean = F.when(text.contains("\r") | text.contains(_STOP), F.translate(text, "\r" + _STOP, "  ")).otherwise(F.coalesce(text, F.lit("")))
    lines = F.regexp_replace(clean, _MARKS, "$1")
    tags = lambda x: F.regexp_replace(F.regexp_replace(x, _JOINT, f"{_STOP}{_TAG} "), _NAME, f"{_STOP}SPDX-License-Identifier $1{_STOP}")
    each_line = F.transform(F.split(lines, "\n"), lambda x: F.when(x.contains(_TAG), tags(x)).otherwise(x))
    lines = F.when(clean.contains(_TAG), F.array_join(each_line, "\n")).otherwise(lines)
    cut = F.split(F.regexp_replace(F.regexp_replace(lines, _BLANK, _STOP), _END, "$1" + _STOP), _STOP)
    none = F.array().cast("array<string>")
    each = F.transform(cut, lambda s: F.struct(_plain(s).alias("whole"), F.when(s.contains("\n"), F.transform(F.split(s, "\n"), _plain)).otherwise(none).alias("parts")))
    return F.transform(F.filter(each, lambda s: s["whole"] != ""), lambda s: F.struct(_canonical(s["whole"]).alias("whole"), F.transform(s["parts"], _canonical).alias("parts")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, list[str]] = SENTENCES, rules=RULES) -> DataFrame:
    """One row per document: doc_id, n_sentences, sentence_ids, licenses, classes (arrays)."""
    by_text = F.create_map(*(F.lit(x) for name, forms in known.items() for form in forms for x in (form, name)))
    forms = [form for of in known.values() for form in of]
    df = docs.select(F.col(id_col).alias("doc_id"), sentences(F.col(text_col).cast("string")).alias("s"))
    parts = lambda s: F.transform(F.filter(s["parts"], lambda p: p.isin(forms)), lambda p: F.element_at(by_text, p))
    found = F.flatten(F.transform("s", lambda s: F.when(s["whole"].isin(forms), F.array(F.element_at(by_text, s["whole"]))).otherwise(parts(s))))
    df = df.select("doc_id", F.size("s").cast("long").alias("n_sentences"), found.alias("sentence_ids"))
    # every identifier stands as |id| so that neighbours do not share a bar
    rest = F.concat(F.lit("|"), F.array_join(F.transform("sentence_ids", lambda k: F.concat(k, F.lit("|"))), "|"))
    ordered = F.array(*(F.struct(F.lit("|" + "||".join(ids) + "|").alias("form"), F.lit(name).alias("name"), F.lit(kind).alias("kind")) for name, kind, ids in rules))
    none = F.array().cast("array<struct<name:string,kind:string>>")

    def applied(acc, r):
        hit = F.struct(F.replace(acc["rest"], r["form"], F.lit("#")).alias("rest"), F.concat(acc["hits"], F.array(F.struct(r["name"], r["kind"]))).alias("hits"))
        return F.when(acc["rest"].contains(r["form"]), hit).otherwise(acc)

    hits = F.aggregate(ordered, F.struct(rest.alias("rest"), none.alias("hits")), applied)["hits"]
    df = df.withColumn("_hits", F.when(F.size("sentence_ids") > 0, hits).otherwise(none))
    return df.select(
        "doc_id",
        "n_sentences",
        "sentence_ids",
        F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["name"]))).alias("licenses"),
        F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["kind"]))).alias("classes"),
    )


def digest(rows: DataFrame) -> DataFrame:
    """Rows of ``scan`` with the arrays as comma-joined strings."""
    return rows.select(
        "doc_id",
        "n_sentences",
        F.size("sentence_ids").cast("long").alias("n_known"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        F.array_join("classes", ",").alias("classes"),
        F.array_contains("classes", "restricted").alias("restricted"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))


def _sql() -> str:
    known = ", ".join(f"('{form}', '{name}')" for name, forms in SENTENCES.items() for form in forms)
    rest, steps = "rest0", []
    for n, (_, _, ids) in enumerate(RULES):
        form = "|" + "||".join(ids) + "|"
        steps.append(f"r{n} AS (SELECT *, contains(rest{n}, '{form}') AS h{n}, replace(rest{n}, '{form}', '#') AS rest{n + 1} FROM {'base' if not n else f'r{n - 1}'})")
    pick = lambda k: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN h{n} THEN '{r[k]}' END" for n, r in enumerate(RULES)) + "], lambda x: x IS NOT NULL))), ',')"
    plain = lambda x: f"trim(lower(regexp_replace({x}, '[^A-Za-z0-9]+', ' ', 'g')))"
    tags = rf"regexp_replace(regexp_replace(x, '{_JOINT}', chr(1) || '{_TAG} ', 'g'), '{_NAME}', chr(1) || 'SPDX-License-Identifier \1' || chr(1), 'g')"
    canonical = "v"
    for pattern, form in PLACEHOLDERS:
        canonical = f"regexp_replace({canonical}, '{pattern}', '{form}')"
    return rf"""
WITH known(v, k) AS (VALUES {known}),
l AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), chr(13) || chr(1), '  '), '{_MARKS}', '\1', 'g') AS t FROM documents),
g AS (SELECT doc_id, CASE WHEN contains(t, '{_TAG}') THEN array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN contains(x, '{_TAG}') THEN {tags} ELSE x END), chr(10)) ELSE t END AS t FROM l),
d AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(t, '{_BLANK}', chr(1), 'g'), '{_END}', '\1' || chr(1), 'g'), chr(1)), lambda s: {plain("s")} <> '') AS s FROM g),
e AS (SELECT doc_id, p, s, {plain("s")} AS v FROM (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS p FROM d)),
w AS (SELECT doc_id, p, s, k FROM (SELECT doc_id, p, s, {canonical} AS v FROM e) LEFT JOIN known USING (v)),
q AS (SELECT doc_id, p, j, {canonical} AS v FROM (SELECT doc_id, p, j, {plain("x")} AS v FROM (SELECT doc_id, p, unnest(string_split(s, chr(10))) AS x, generate_subscripts(string_split(s, chr(10)), 1) AS j FROM w WHERE k IS NULL AND contains(s, chr(10))))),
a AS (SELECT doc_id, p, 0 AS j, k FROM w WHERE k IS NOT NULL UNION ALL SELECT doc_id, p, j, k FROM q JOIN known USING (v)),
f AS (SELECT doc_id, list(k ORDER BY p, j) AS ids FROM a GROUP BY doc_id),
base AS (SELECT d.doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_known,
         coalesce(array_to_string(ids, ','), '') AS sentence_ids,
         coalesce('|' || array_to_string(list_transform(ids, lambda k: k || '|'), '|'), '|') AS rest0 FROM d LEFT JOIN f USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, n_sentences, n_known, sentence_ids, {pick(0)} AS licenses, {pick(1)} AS classes, contains({pick(1)}, 'restricted') AS restricted FROM r{len(RULES) - 1}
"""


SQL = _sql()
