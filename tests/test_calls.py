import pytest

from tessera.functions.calls import links_in


@pytest.mark.parametrize(
    "text, kind, links",
    [
        ("import requests\nx = requests.get('http://h/api', timeout=3).json()", ".py", [("http", "http://h/api")]),
        ("async def f(i):\n    await httpx.post(f'http://h/{i}/b', json={})", ".py", [("http", "http://h/{i}/b")]),
        ("requests.request('POST', '/one')\nrequests.request(method='PUT', url='/two')\nrequests.get(url='/three')", ".py", [("http", "/one"), ("http", "/two"), ("http", "/three")]),
        ("# requests.get('/no')\ns = \"requests.get('/no')\"\nrequests.head('/no')\nrequests.get(path)\nrequests.get('/a')\nlib.requests.get('/lib')", ".py", [("http", "/lib")]),
        ("p.produce('orders.new', value)\nc.subscribe(['in-1', 'in-2'])\nc.subscribe(topics=['x.y'])\nc.subscribe('no')\nproduce('no')\np.produce('1no')", ".py", [("made", "orders.new"), ("used", "in-1"), ("used", "x.y")]),
        ("const r = await fetch(`/v2/${id}/x`, { method: 'POST' }); window.fetch('/v3/y')", ".js", [("http", "/v2/${id}/x"), ("http", "/v3/y")]),
        ("axios\n  .get('/a/list')\n  .then(r => axios.post(\"/b/list\", r))\n// axios.get('/no')\nprefetch('/no/x'); axios.head('/no/x')", ".ts", [("http", "/a/list"), ("http", "/b/list")]),
        ("axios.delete({ url: '/c/d', data: { url: '/no' } })", ".js", [("http", "/c/d")]),
        ("const a = `${axios.get('/inside/only')}`", ".js", []),
        ("<p>don't</p>\nfetch('/in/vue')", ".vue", [("http", "/in/vue")]),
        ("def broken(:\n    requests.get('/still/found')", ".py", [("http", "/still/found")]),
        ("requests.get('/same')\nrequests.get('/same')", ".py", [("http", "/same")]),
        ("", ".py", []),
        (None, ".js", []),
        ("fetch(", ".js", []),
        ("a?.b.fetch('/opt/chain')", ".js", [("http", "/opt/chain")]),
    ],
)
def test_links(text, kind, links):
    assert links_in(text, kind) == links
