"""License texts and notices as templates (fixed values).

Wording is mandatory, compared by words. ``<<beginOptional>> .. <<endOptional>>`` may be missing, ``<<var;0-9>>``
stands for so many words of any kind, ``<<one;a|b>>`` for one of the words or phrases.
"""

TEMPLATES = [
    ("mit", """<<beginOptional>>the mit license<<endOptional>> <<beginOptional>>copyright <<var;0-20>><<endOptional>>
permission is hereby granted, free of charge, to any person obtaining a copy of <<one;this software|this work>> and associated
documentation files (the <<one;software|work>>), to deal in the <<one;software|work>> without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
<<one;software|work>>, and to permit persons to whom the <<one;software|work>> is furnished to do so, subject to the following
conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the
<<one;software|work>>."""),
    ("mit", """<<one;released|licensed|distributed|available|provided>> under <<beginOptional>>the terms of<<endOptional>> the
mit license<<beginOptional>>, see <<var;1-6>><<endOptional>>"""),
    ("isc", """permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd", """redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: <<var;0-1>> redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer<<beginOptional>> in this position and unchanged<<endOptional>>. <<var;0-1>>
redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution."""),
    ("bsd", """<<one;released|licensed|distributed|available>> under <<beginOptional>>the terms of<<endOptional>> the
<<one;2 clause|3 clause|new|simplified|modified>> bsd license"""),
    ("apache", """licensed under the apache license, version 2.0<<beginOptional>> (the "license"); you may not use
<<one;this file|these files|this work>> except in compliance with the license<<endOptional>><<beginOptional>>. you may obtain a copy
of the license at <<var;1-12>><<endOptional>>"""),
    ("apache", """apache license version 2.0, january 2004 <<var;0-8>> terms and conditions for use, reproduction, and
distribution"""),
    ("gpl", """<<one;this program|this work|this library|this file|this package>> is <<one;licensed|released|distributed>> under
<<beginOptional>>the terms of<<endOptional>> the gnu <<beginOptional>><<one;lesser|affero>><<endOptional>> general public license,
version <<var;1-1>><<beginOptional>> or <<beginOptional>>(at your option) any<<endOptional>> later
<<beginOptional>>version<<endOptional>><<endOptional>>"""),
    ("gpl", """is free software<<one;:|;>> you can redistribute it and/or modify it under the terms of the gnu
<<beginOptional>><<one;lesser|affero>><<endOptional>> general public license as published by the free software foundation
<<var;0-12>> any later version"""),
    ("cc", """<<beginOptional>><<one;this work|this text|this page>> is<<endOptional>> licensed under
<<beginOptional>>a<<endOptional>> <<one;cc|creative commons>> <<one;by|attribution>>
<<beginOptional>><<one;nc|noncommercial|sa|nd|sharealike>><<endOptional>> <<beginOptional>><<one;sa|nd|sharealike>><<endOptional>>
<<beginOptional>>license<<endOptional>> <<one;1.0|2.0|2.5|3.0|4.0>> <<beginOptional>>international
<<beginOptional>>license<<endOptional>><<endOptional>>"""),
    ("unlicense", """this is free and unencumbered software released into the public domain. anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software"""),
    ("zlib", """this software is provided as-is, without any express or implied warranty. in no event will the authors be held
liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any
purpose"""),
]

#: Phrases whose words stand together, with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
