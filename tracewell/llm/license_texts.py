"""Licence wording that the scan knows: the grants and conditions of short licences, and the notices by which long ones are applied.

Public texts, stated as their publishers print them but for names, years, addresses
and disclaimers, which many licences share.
"""

from __future__ import annotations

_MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_MIT_NOTICE = "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAME = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"


def _gnu(what: str, name: str, version: str) -> str:
    """The first sentence of the notice by which a work is put under a licence of the GNU family."""
    return (
        f"this {what} is free software you can redistribute it and or modify it under the terms of the gnu {name} general public license "
        f"as published by the free software foundation either version {version} of the license or at your option any later version"
    )


def _commons(kind: str, version: str = "4 0 international") -> str:
    return f"this work is licensed under a creative commons {kind} {version} license"


TEMPLATES = {
    "mit": f"{_MIT_GRANT} {_MIT_NOTICE}",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "bsd-2": f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY}",
    "bsd-3": f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAME}",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "boost-1": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "epl-2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "gpl-2": _gnu("program", "", "2").replace("  ", " "),
    "gpl-3": _gnu("program", "", "3").replace("  ", " "),
    "agpl-3": _gnu("program", "affero", "3"),
    "lgpl-2.1": _gnu("library", "lesser", "2 1"),
    "lgpl-3": _gnu("library", "lesser", "3"),
    "cc-by": _commons("attribution"),
    "cc-by-sa": _commons("attribution sharealike"),
    "cc-by-nc": _commons("attribution noncommercial"),
    "cc-by-nd": _commons("attribution noderivatives"),
    "cc-by-nc-sa": _commons("attribution noncommercial sharealike"),
    "cc-by-nc-nd": _commons("attribution noncommercial noderivatives"),
    "cc0-1": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
}
